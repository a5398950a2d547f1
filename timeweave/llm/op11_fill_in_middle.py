"""Fill-in-the-middle transformation over seekable compressed frames.

``store`` turns each text into independent zstandard frames of a fixed number of bytes. Each frame
carries how many units (lines) end, and how many code points begin, before it, so that a cut after
any number of units is found by a search over these sums and the decompression of one frame: the
*cut frame*. ``transform`` draws two cuts a document from the digest of its id, and ``stream`` gives
the output in order, frame by frame: whole frames as they are, cut frames in part. Digests and
lengths are taken from that stream; ``texts`` joins it to the output text. ``Restorer`` reads an
output stream back without the document: it finds the marks, passes prefix and middle on as they
come, and holds the suffix in compressed frames until the middle is through.

Frames of a document stay in its row, as its text did, so nothing is shuffled. Memory is that of a
batch of rows (compressed), one open frame, and a compressed suffix.

Defined results: a null text is an empty one. A null id is drawn as the empty string after the
prefix. A text that is empty, or holds one of the marks, is plain: output and text are the same.
Equal ids have equal draws. Lines of any length, and texts of one line, are cut as any others: at
0 or all units a part is empty. Columns besides id and text are not read and may have any names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import Store, by_batch

# The marks, and what is put before an id that is drawn.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SALT = "7:"
#: Bytes of text in a frame, before compression.
FRAME = 1 << 16
LEVEL = 3

_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))
_STORED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("n_chars", pa.int64()), ("n_bytes", pa.int64()), ("marked", pa.bool_()), ("frames", _FRAMES)])
STORED = "doc_id long, n long, n_chars long, n_bytes long, marked boolean, frames array<struct<units:long,chars:long,data:binary>>"
_CONTINUED = bytes(range(0x80, 0xC0))


@cache
def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL)


@cache
def _reader() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def code_points(data: bytes) -> int:
    """How many code points begin in these bytes of UTF-8."""
    return len(data) if data.isascii() else len(data.translate(None, _CONTINUED))


class Frames:
    """One document's frames: search by units, and streaming from byte to byte."""

    def __init__(self, n: int, n_chars: int, n_bytes: int, units: list[int], chars: list[int], data: list[bytes], size: int = FRAME):
        self.n, self.n_chars, self.n_bytes = n, n_chars, n_bytes
        self.units, self.chars, self.data, self.size = units, chars, data, size
        self.open, self.opened = b"", -1

    def frame(self, i: int) -> bytes:
        if self.opened != i:
            self.open, self.opened = _reader().decompress(self.data[i]), i
        return self.open

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points before the end of so many units."""
        if units <= 0:
            return 0, 0
        if units >= self.n:
            return self.n_bytes, self.n_chars
        i = bisect_left(self.units, units) - 1  # the last frame before which fewer units end
        whole, at = self.frame(i), -1
        for _ in range(units - self.units[i]):
            at = whole.index(b"\n", at + 1)
        return i * self.size + at + 1, self.chars[i] + code_points(whole[: at + 1])

    def stream(self, begin: int, end: int) -> Iterator[bytes]:
        """The bytes from ``begin`` to ``end``, a frame at a time."""
        while begin < end:
            i = begin // self.size
            part = self.frame(i)[begin - i * self.size : end - i * self.size]
            yield part
            begin += len(part)


def pack(text: bytes, size: int = FRAME) -> tuple[int, int, list[dict]]:
    """Units and code points of a text, and its frames."""
    units = chars = 0
    frames = []
    for at in range(0, len(text), size):
        part = text[at : at + size]
        frames.append({"units": units, "chars": chars, "data": _packer().compress(part)})
        units, chars = units + part.count(b"\n"), chars + code_points(part)
    return units + (not text.endswith(b"\n") and text != b""), chars, frames


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = FRAME) -> DataFrame:
    """``doc_id, n`` (units)``, n_chars, n_bytes, marked`` (holds a mark)``, frames`` of each row."""

    def columns(batch: pa.RecordBatch) -> list:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        packed = [pack(t, size) for t in texts]
        marked = [PREFIX in t or SUFFIX in t or MIDDLE in t for t in texts]
        return [batch.column(0), [p[0] for p in packed], [p[1] for p in packed], [len(t) for t in texts], marked, [p[2] for p in packed]]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(by_batch(columns, _STORED), STORED)


class Plan:
    """The form of a document's output, and where its cuts lie (bytes and code points)."""

    def __init__(self, doc_id: int | None, marked: bool, own: Frames, rate: int, spm: int):
        digest = hashlib.sha256(f"{SALT}{'' if doc_id is None else doc_id}".encode()).digest()
        h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
        self.form, self.first, self.second = "plain", (0, 0), (0, 0)
        if own.n_bytes and not marked and h3 % 100 < rate:
            self.form = "spm" if h4 % 100 < spm else "psm"
            ends = sorted((h1 % (own.n + 1), h2 % (own.n + 1)))
            self.first, self.second = own.cut(ends[0]), own.cut(ends[1])

    def stream(self, own: Frames) -> Iterator[bytes]:
        """The output, in order."""
        a, b, end = self.first[0], self.second[0], own.n_bytes
        parts = {"plain": [(b"", 0, end)], "psm": [(PREFIX, 0, a), (SUFFIX, b, end), (MIDDLE, a, b)], "spm": [(SUFFIX, b, end), (PREFIX, 0, a), (MIDDLE, a, b)]}
        for mark, begin, till in parts[self.form]:
            yield mark
            yield from own.stream(begin, till)


class Restorer:
    """Gives the text back from the stream of an output and its form alone."""

    def __init__(self, form: str):
        self.form = form
        self.order = {"psm": [PREFIX, SUFFIX, MIDDLE], "spm": [SUFFIX, PREFIX, MIDDLE]}.get(form, [])
        self.held: list[bytes] = []

    def _parts(self, output: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(mark, bytes that follow it), in pieces; a mark may lie over the edge of two."""
        left, now, ahead = b"", b"", list(self.order)
        for piece in output:
            left += piece
            while ahead and (at := left.find(ahead[0])) >= 0:
                if at:
                    yield now, left[:at]
                now, left = ahead.pop(0), left[at + len(PREFIX) :]
            sure = len(left) - (len(PREFIX) - 1 if ahead else 0)
            if sure > 0:
                yield now, left[:sure]
                left = left[sure:]
        if ahead:
            raise ValueError(f"not an output of form {self.form}: no {ahead[0].decode()}")
        if left:
            yield now, left

    def stream(self, output: Iterable[bytes]) -> Iterator[bytes]:
        for mark, part in self._parts(output):
            if mark == SUFFIX:
                self.held.append(_packer().compress(part))
            else:
                yield part
        yield from map(_reader().decompress, self.held)


def _each(batch: pa.RecordBatch, rate: int, spm: int, size: int) -> Iterator[tuple[Frames, Plan]]:
    ids, ns, chars, sizes, marked = (batch.column(c).to_pylist() for c in ("doc_id", "n", "n_chars", "n_bytes", "marked"))
    for i, frames in enumerate(batch.column("frames")):
        found = frames.as_py()
        own = Frames(ns[i], chars[i], sizes[i], [f["units"] for f in found], [f["chars"] for f in found], [f["data"] for f in found], size)
        yield own, Plan(ids[i], marked[i], own, rate, spm)


def _hexdigest(parts: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def _applied(stored: DataFrame, more: list[tuple[str, pa.DataType, str]], of, rate: int, spm: int, size: int) -> DataFrame:
    own = [("doc_id", pa.int64(), "long"), ("n", pa.int64(), "long"), ("form", pa.string(), "string"), ("prefix_chars", pa.int64(), "long"), ("middle_chars", pa.int64(), "long"), *more]

    def columns(batch: pa.RecordBatch) -> list:
        rows = []
        for frames, plan in _each(batch, rate, spm, size):
            cut = (None, None) if plan.form == "plain" else (plan.first[1], plan.second[1] - plan.first[1])
            rows.append((plan.form, *cut, *of(frames, plan)))
        made = list(zip(*rows, strict=True)) if rows else [()] * (3 + len(more))
        return [batch.column("doc_id"), batch.column("n"), *map(list, made)]

    return stored.mapInArrow(by_batch(columns, pa.schema([(n, t) for n, t, _ in own])), ", ".join(f"{n} {s}" for n, _, s in own))


def transform(stored: DataFrame, rate: int = 100, spm: int = 50, size: int = FRAME) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of each stored
    document: digests of the output's stream, and of the text read back from such a stream. ``rate``
    and ``spm`` are percentages: of documents that are transformed, and of these with the suffix first."""

    def of(frames: Frames, plan: Plan) -> tuple:
        return _hexdigest(plan.stream(frames)), _hexdigest(Restorer(plan.form).stream(plan.stream(frames)))

    digests = [("output_sha256", pa.string(), "string"), ("restored_sha256", pa.string(), "string")]
    return _applied(stored, digests, of, rate, spm, size)


def texts(stored: DataFrame, rate: int = 100, spm: int = 50, size: int = FRAME) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: the outputs themselves."""
    return _applied(stored, [("output", pa.string(), "string")], lambda frames, plan: (b"".join(plan.stream(frames)).decode(),), rate, spm, size)


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The rows with ``restored``, the texts that the outputs were made from."""

    def columns(batch: pa.RecordBatch) -> list:
        streams = zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True)
        return [b"".join(Restorer(form).stream([output])).decode() for output, form in streams]

    own = F.struct(*[F.col(f"`{c}`") for c in outputs.columns]).alias("own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(columns(batch), pa.string()), batch.column(2)], ["restored", "own"])

    rows = outputs.select(F.col(output_col), F.col(form_col), own)
    kind = rows.schema["own"].dataType.simpleString()
    return rows.mapInArrow(run, f"restored string, own {kind}").select("own.*", "restored")


def digests(docs: DataFrame, rate: int = 100, spm: int = 50) -> DataFrame:
    """Stores the documents in the shared folder and transforms them."""
    return transform(Store(docs.sparkSession, "frames").keep(store(docs), "stored"), rate, spm)


#: The same rows by SQL.
SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (
  SELECT doc_id, text, units, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS u1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS u2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:least(u1, u2)], '') AS p, array_to_string(units[least(u1, u2) + 1:greatest(u1, u2)], '') AS m, array_to_string(units[greatest(u1, u2) + 1:], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
