"""Token ids in length-delimited binary shards, with a separate offset index.

A shard is a plain file of records, one a document, in ascending document order:

    length of the payload   unsigned 64-bit
    its masked checksum     unsigned 32-bit, of the eight length bytes
    payload                 ids, unsigned 16-bit where the vocabulary allows it, else 32-bit
    its masked checksum     unsigned 32-bit

all little-endian. A masked checksum is the CRC-32 turned right by 15 bits plus 0xA282EAD8, so
that a checksum of data that holds checksums stays meaningful. The index is a Parquet table with a
row for each record (shard, file, position, byte offset and length, tokens before it in the
shard), written by Spark beside the shards. A reader goes to any record by its offset.

Documents are range-partitioned by id and the beginning of their text (so rows of one id are not one
task), and sorted by id and text, so shards are in global order. A task writes its
shard under a name of its own; only the index says which files count, and Spark commits the index
rows of one attempt alone. A lost executor or a speculative copy leaves at most a file that no row
names. The number of tokens before a shard comes from one row a shard.

Defined results: null or empty text has the end id alone. Rows of equal ids (null ids first) stay
separate records, in the order of their texts. An empty table has an empty index. Columns but id and
text are not read, and may have any names.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.llm.bpe import byte_letters, check
from timeweave.llm.common import Memo, Store, by_batch, held
from timeweave.llm.op1_token_counts import split_special
from timeweave.llm.pieces import cut

MAX_PIECES = 300_000
INDEX = "shard int, file string, doc_id long, position long, offset long, length long, n_tokens long, before long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of a record; ValueError where a checksum or the length is wrong."""
    length, check = record[:8], record[8:12]
    payload, last = record[12:-4], record[-4:]
    if struct.pack("<I", masked(length)) != check or struct.unpack("<Q", length)[0] != len(payload) or struct.pack("<I", masked(payload)) != last:
        raise ValueError("a damaged record")
    return payload


class LibraryEncoder:
    """Ids by the tokenizers library. It merges within pieces, so each distinct piece goes to the
    library's model once, as the letters that stand for its bytes, and its ids are kept, up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            check(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.dtype = ("H", "<u2") if self.tokenizer.get_vocab_size(True) <= 1 << 16 else ("I", "<u4")
        self.model = self.tokenizer.model
        self.model = self.tokenizer.model
        self.special = {t.content: self.pack([i]) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.packed = Memo(self.encode_piece, MAX_PIECES)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def encode_piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return self.pack([t.id for t in self.model.tokenize(letters)])

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        self.packed.age()
        parts, owners = [], []
        out: list[list[bytes]] = [[] for _ in texts]
        for i, text in enumerate(texts):
            for part in split_special(text, self.special):
                parts.append(part)
                owners.append(i)
        for i, part, pieces in zip(owners, parts, cut(parts), strict=True):
            if part in self.special:
                out[i].append(self.special[part])
            else:
                out[i] += map(self.packed.__getitem__, pieces)
        last = self.pack([end])
        return [b"".join((*x, last)) for x in out]


def encoder(path: str) -> LibraryEncoder:
    return held(("library", path), lambda: LibraryEncoder(path))


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the shards and the index of all documents into ``folder``; returns the index."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = TaskContext.get().partitionId(), encoder(vocabulary)
        store, root = fs.FileSystem.from_uri(folder)
        name, out, position, offset, before = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin", None, 0, 0, 0
        width = np.dtype(own.dtype).itemsize
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(f"{root}/shards", recursive=True)
                out = store.open_output_stream(f"{root}/shards/{name}")
            index = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, payload in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist(), end_id), strict=True):
                    record, n = frame(payload), len(payload) // width
                    out.write(record)
                    index.append((shard, name, doc_id, position, offset, len(record), n, before))
                    position, offset, before = position + 1, offset + len(record), before + n
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], ["shard", "file", "doc_id", "position", "offset", "length", "n_tokens", "before"])
        if out is not None:
            out.close()

    ordered.mapInArrow(write_shard, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(index: DataFrame, folder: str, dtype: str) -> DataFrame:
    """The records that ``index`` has rows for, in any order: its columns and ``ids`` (binary,
    little-endian unsigned 32-bit)."""

    def columns(batch: pa.RecordBatch) -> list:
        store, root = fs.FileSystem.from_uri(folder)
        files, out = {}, []
        for name, offset, length in zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True):
            if name not in files:
                files[name] = store.open_input_file(f"{root}/shards/{name}")
            record = files[name].read_at(length, offset)
            out.append(np.frombuffer(unframe(record), dtype).astype("<u4").tobytes())
        for f in files.values():
            f.close()
        return [batch.column("shard"), batch.column("doc_id"), batch.column("n_tokens"), batch.column("before"), out]

    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("ids", pa.binary())])
    return index.mapInArrow(by_batch(columns, schema), "shard int, doc_id long, n_tokens long, before long, ids binary")


def digests(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes all documents, reads the files back, and returns a row for each from them; the files go
    then."""
    store = Store(spark, "records")
    folder = f"{store.root}/files"
    index = write(docs, folder, vocabulary, end_id)
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a shard
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    records = read(index, folder, encoder(vocabulary).dtype)
    rows = records.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
    result = store.keep(rows, "digests")
    store.drop("files")
    return result
