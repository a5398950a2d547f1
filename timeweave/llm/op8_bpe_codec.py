"""Byte-level BPE encoding and decoding by backtracking over Aho-Corasick matches.

The bytes of a piece, mapped to the Latin-1 characters of the same numbers, go through an
automaton of all tokens, which gives the longest match from a byte on. The encoder takes the
longest token that is compatible with the one before it, and steps back where none is. The
encoding of a prefix is unique, so a place from which no token leads on never needs a second
visit: one bit for each byte makes the whole walk linear, and its result that of the merges.

Compatibility of neighbours and the ids of short pieces are memoised, up to a bound.

Defined results: null or empty text has no ids, and decodes to no bytes. Each input row gives one
output row, whatever its id (null and repeated ids included). Only the two named columns are read,
so other columns may have any names; they are not in the result.
"""

from __future__ import annotations

from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm import bpe
from timeweave.llm.common import Memo, by_batch, held

MAX_PIECES = 200_000


class Codec:
    def __init__(self, path: str, pattern: str):
        self.merges = bpe.load(path)
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token in self.merges.tokens:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.most = max(map(len, self.merges.tokens))
        self.bytes_of = {i: t for t, i in self.merges.ids.items()}
        self.packed = Memo(self.encode_piece, MAX_PIECES)

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern as little-endian unsigned 32-bit integers."""
        data = piece.encode("utf-8", "surrogatepass")
        return array("I", map(self.merges.ids.__getitem__, self.backtrack(data))).tobytes()

    def backtrack(self, data: bytes) -> list[bytes]:
        tokens = self.merges.tokens
        if data in tokens:
            return [data]
        letters, longest = data.decode("latin-1"), self.automaton.longest_prefix
        known, compatible = self.merges.compatible_memo, self.merges.compatible
        dead, chosen, at, before = bytearray(len(data) + 1), [], 0, None
        n = longest(letters[: self.most])
        while at < len(data):
            while n:
                token = data[at : at + n]
                if token in tokens and not dead[at + n]:
                    fits = before is None or known.get((before, token))
                    if fits is None:
                        fits = compatible(before, token)
                    if fits:
                        break
                n -= 1
            if n:
                chosen.append(token)
                at, before = at + n, token
                n = longest(letters[at : at + self.most])
            else:
                if before is None:
                    raise ValueError("the vocabulary lacks a single byte")
                dead[at] = 1
                n = len(chosen.pop())
                at, n = at - n, n - 1
                before = chosen[-1] if chosen else None
        return chosen

    def encode(self, text: str) -> bytes:
        self.packed.age()
        return b"".join(map(self.packed.__getitem__, self.pattern.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, ids`` (binary, little-endian unsigned 32-bit integers)."""

    def columns(batch: pa.RecordBatch) -> list:
        own = codec(vocabulary, pattern)
        return [batch.column(0), [own.encode(t.as_py()) for t in batch.column(1)]]

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    return _texts(docs, id_col, text_col).mapInArrow(by_batch(columns, schema), "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` and the ``decoded`` bytes of the ids."""

    def columns(batch: pa.RecordBatch) -> list:
        own = codec(vocabulary, pattern)
        return [batch.column(0), batch.column(1), [own.decode(x.as_py()) for x in batch.column(1)]]

    return encoded.select("doc_id", "ids").mapInArrow(
        by_batch(columns, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])), "doc_id long, ids binary, decoded binary"
    )


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``, and whether the decoded bytes are those of the text (``exact``).

    The same rows as ``decode(encode(...))``, with one codec, in one Python worker for each task.
    """

    def columns(batch: pa.RecordBatch) -> list:
        own = codec(vocabulary, pattern)
        texts = batch.column(1).to_pylist()
        ids = [own.encode(t) for t in texts]
        decoded = [own.decode(x) for x in ids]
        return [batch.column(0), ids, decoded, [d == t.encode("utf-8", "surrogatepass") for d, t in zip(decoded, texts, strict=True)]]

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary()), ("exact", pa.bool_())])
    return _texts(docs, id_col, text_col).mapInArrow(by_batch(columns, schema), "doc_id long, ids binary, decoded binary, exact boolean")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
