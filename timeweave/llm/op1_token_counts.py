"""Token counts by a compiled finite-state tokenizer, without making the tokens.

Two transducers in a row give the count. The first (:mod:`timeweave.llm.pieces`) cuts a text into
pieces; its chunk state maps compose through a parallel prefix scan, so that a long text needs no
sequential walk. The second reads the bytes of a piece; each transition carries the number of
tokens that the prefix gains (or loses, when a byte lets tokens merge), so that the count of a
piece is the sum along its path, and the count of a text that of its pieces.

The second transducer is compiled on demand, as its states are only those that texts reach. A
state remembers what the next byte can depend on: the longest suffix read that begins some token,
and, for each place in it where such a token may begin, the token before that place and the count
there. The new last token is then the longest one whose predecessor is compatible with it. States
and counts of pieces are kept up to a bound and then built anew, so memory stays bounded.

Special strings inside a text count as the library's default has it: one token each.

Defined results: null or empty text has 0 bytes and 0 tokens. Each input row gives one output row,
whatever its id (null and repeated ids included). Only the two named columns are read.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm import bpe
from timeweave.llm.common import Memo, by_batch, held
from timeweave.llm.pieces import cut

MAX_STATES, MAX_PIECES = 250_000, 200_000
START = (b"", ((0, None, 0),))


class CountingTransducer:
    """Counts the tokens of a piece; one for each vocabulary and worker."""

    def __init__(self, merges: bpe.MergeTable):
        self.merges = merges
        self.prefixes = {t[:i] for t in merges.tokens for i in range(1, len(t) + 1)} | {b""}
        self.counts = Memo(self.count, MAX_PIECES)
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {START: 0}
        self.keys: list[tuple] = [START]
        self.nexts: list[dict[int, tuple[int, int]]] = [{}]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state by a byte: (next state, tokens gained)."""
        suffix, places = self.keys[state]
        read = suffix + bytes([byte])
        tokens, compatible = self.merges.tokens, self.merges.compatible
        for at, before, count in places:  # from the longest candidate on
            token = read[at:]
            if token in tokens and (before is None or compatible(before, token)):
                last, total = token, count + 1
                break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        kept = [(at, before, count) for at, before, count in places if read[at:] in self.prefixes]
        cut_off = kept[0][0] if kept else len(read)
        key = (read[cut_off:], tuple((at - cut_off, before, count - total) for at, before, count in [*kept, (len(read), last, total)]))
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.nexts.append({})
        self.nexts[state][byte] = target, total
        return target, total

    def count(self, piece: str) -> int:
        if len(self.keys) > MAX_STATES:
            self.reset()
        state = total = 0
        nexts = self.nexts
        for byte in piece.encode("utf-8", "surrogatepass"):
            state, gain = nexts[state].get(byte) or self.compile(state, byte)
            total += gain
            if len(nexts) > 2 * MAX_STATES:  # one endless piece
                key = self.keys[state]
                self.reset()
                nexts, state = self.nexts, 0
                if key != START:
                    state = self.states[key] = 1
                    self.keys.append(key)
                    nexts.append({})
        return total

    def count_all(self, pieces: list[str]) -> int:
        self.counts.age()
        return sum(map(self.counts.__getitem__, pieces))


def transducer(path: str) -> CountingTransducer:
    return held(("counts", path), lambda: CountingTransducer(bpe.load(path)))


def split_special(text: str, special: dict[str, int]) -> list[str]:
    """The text between special strings, and each of these strings."""
    if not special or not any(s in text for s in special):
        return [text]
    return regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens)."""

    def columns(batch: pa.RecordBatch) -> list:
        counter = transducer(vocabulary)
        special = counter.merges.special
        parts, owners, texts = [], [], batch.column(1).to_pylist()
        counts = [0] * len(texts)
        for i, text in enumerate(texts):
            for part in split_special(text or "", special):
                if part in special:
                    counts[i] += 1
                elif part:
                    parts.append(part)
                    owners.append(i)
        for i, pieces in zip(owners, cut(parts), strict=True):
            counts[i] += counter.count_all(pieces)
        return [batch.column(0), counts]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = rows.select(F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).alias("of"), "text")
    of = pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64())])
    counted = sized.mapInArrow(by_batch(columns, pa.schema([("of", of), ("n_tokens", pa.int64())])), "of struct<doc_id:long,n_bytes:long>, n_tokens long")
    return counted.select("of.doc_id", "of.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
