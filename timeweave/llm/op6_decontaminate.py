"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are folded alike: lower case, each run of signs and white space of any script one
space, signs of scripts without spaces words of their own, as UTF-8 bytes, with a space at both ends; so
an end of a match that cuts a word is an edit like others. An item of m bytes (without these ends) has
an error budget of k = floor(rate m) edits, whatever m. Cut into k + 1 pieces, any passage within k edits of it holds one piece unchanged, at its place give or take
k bytes. An automaton over the pieces of all items finds these places in one walk over the text. The
same holds of groups of pieces: one of the groups of g pieces has g - 1 edits at most and an unchanged
piece, and as an edit changes four of its four-byte grams at most, a place with fewer of them than
that leaves is ruled out without loss. The grams around a hit are collected once for all items that
list its piece; where these are many, only items that share grams with the place are looked at, by an
index of the piece's own. Windows around the other places are merged, the grams of the
whole item are counted in the same way, and Myers' bit-parallel distance (one arbitrarily long
integer a column) decides each window that is left.

Documents are not shuffled, and each text is read whole. Test items go to the tasks in blocks of a
bounded size, one pass over the documents each.

Defined results: an item whose budget is 0 matches exact copies whose ends do not cut a word. An item
that is null or folds to nothing matches nothing. A null or empty text has no hits. An item that occurs in a text several times gives one row, with the
least distance and the first place that has it. Repeated rows and items are rows of their own. Only
the named columns are read; ``clean`` gives all columns back, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import Store, held
from timeweave.llm.toxicity import _UNSPACED

BLOCK_BYTES = 4 << 20
#: Bytes of the grams that are counted before a distance is computed, and pieces of a group.
GRAM, GROUP = 4, 4
#: Errors for a byte of an item.
RATE = 0.1
#: Items that list a piece from which on the piece has an index of grams.
MANY = 16
_SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_OTHER_SIGNS = re.compile(r"[^\w]+")


def fold(text: str) -> bytes:
    text = text.lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", _OTHER_SIGNS.sub(" ", text))
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_SIGNS).split())


def framed(folded: bytes) -> bytes:
    return b" " + folded + b" "


class Item:
    def __init__(self, item_id: int, data: bytes, rate: float):
        self.item_id, self.data = item_id, data
        self.budget = int(rate * (len(data) - 2))  # the frame does not count
        self.masks: dict[int, int] = {}
        for i, b in enumerate(data):
            self.masks[b] = self.masks.get(b, 0) | 1 << i

        self.grams = [data[i : i + GRAM] for i in range(len(data) - GRAM + 1)]

    def pieces(self) -> Iterator[tuple[int, bytes, int, int, int]]:
        """Offset and bytes of budget + 1 pieces that cover the item; start, end and budget of each
        one's group. A group of g pieces has g - 1 errors: if every group had more, the item would
        have more than its own."""
        n = self.budget + 1
        ends = [len(self.data) * i // n for i in range(n + 1)]
        for first in range(0, n, GROUP):
            if n - first < GROUP and first:
                break
            after = n if n - first < 2 * GROUP else first + GROUP
            for i in range(first, after):
                yield ends[i], self.data[ends[i] : ends[i + 1]], ends[first], ends[after], after - first - 1

    def needed(self, start: int, end: int, budget: int) -> tuple[list[bytes], int]:
        """The grams of a part of the item, and how many of them any text within ``budget`` of it holds: an
        error changes ``GRAM`` of them at most."""
        grams = self.grams[start : max(start, end - GRAM + 1)]
        return grams, len(grams) - GRAM * budget

    def keeps_grams(self, text: bytes) -> bool:
        """False only where no part of ``text`` is within the budget of the item."""
        grams, least = self.needed(0, len(self.data), self.budget)
        return least <= 0 or sum(map(grams_of(text).__contains__, grams)) >= least

    def distance(self, text: bytes) -> tuple[int, int]:
        """The least edit distance of the item to any part of ``text``, and where that part ends."""
        m = len(self.data)
        every, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = every, 0, m
        best, end = m, 0
        masks = self.masks
        for j, b in enumerate(text, 1):
            equal = masks.get(b, 0)
            across = (((equal & plus) + plus) ^ plus) | equal
            down = equal | minus
            up = minus | (every & ~(across | plus))
            drop = plus & across
            if up & top:
                score += 1
            elif drop & top:
                score -= 1
                if score < best:
                    best, end = score, j
            up = (up << 1) & every
            drop = (drop << 1) & every
            plus = drop | (every & ~(down | up))
            minus = up & down
        return best, end


def grams_of(text: bytes) -> set[bytes]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


class Piece:
    """The places of a piece: items that list it, where, and what its group needs. ``reach`` is how far
    before and after the piece any of the groups may lie."""

    def __init__(self, data: bytes):
        self.data, self.places, self.reach = data, [], [0, 0]
        self.index: dict[bytes, list[int]] | None = None

    def add(self, n: int, item: Item, at: int, start: int, end: int, budget: int) -> None:
        self.places.append((n, at, *item.needed(start, end, budget)))
        self.reach[0] = max(self.reach[0], at - start + budget)
        self.reach[1] = max(self.reach[1], end - at - len(self.data) + budget)

    def close(self) -> None:
        if len(self.places) >= MANY:
            self.index = {}
            for p, (_, _, grams, _) in enumerate(self.places):
                for gram in grams:
                    self.index.setdefault(gram, []).append(p)

    def kept(self, text: bytes, begin: int) -> Iterator[tuple[int, int]]:
        """Items, and their offset of the piece, whose group can be at this place of ``text``."""
        have = grams_of(text[max(0, begin - self.reach[0]) : begin + len(self.data) + self.reach[1]])
        if self.index is None:
            for n, at, grams, least in self.places:
                if least <= 0 or sum(map(have.__contains__, grams)) >= least:
                    yield n, at
            return
        counts = Counter(chain.from_iterable(self.index[g] for g in have if g in self.index))
        for p, (n, at, _, least) in enumerate(self.places) if self.loose else ((p, self.places[p]) for p in counts):
            if counts[p] >= least:
                yield n, at

    @cached_property
    def loose(self) -> bool:
        """Whether an item may need no gram at all."""
        return any(least <= 0 for *_, least in self.places)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [Item(i, framed(d), rate) for i, t in items if (d := fold(t))]
        pieces: dict[bytes, Piece] = {}
        for n, item in enumerate(self.items):
            for at, data, *group in item.pieces():
                pieces.setdefault(data, Piece(data)).add(n, item, at, *group)
        self.automaton = ahocorasick.Automaton()
        for data, piece in pieces.items():
            piece.close()
            self.automaton.add_word(data.decode("latin-1"), piece)
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """``item_id, distance, budget, end`` of each item within its budget."""
        if not self.items:
            return []
        data, found = framed(fold(text)), []
        windows: dict[int, list[list[int]]] = {}
        for last, piece in self.automaton.iter(data.decode("latin-1")):
            place = last + 1 - len(piece.data)
            for n, at in piece.kept(data, place):
                item = self.items[n]
                start = place - at - item.budget
                stop = start + len(item.data) + 2 * item.budget
                own = windows.setdefault(n, [])
                if own and start <= own[-1][1]:
                    own[-1] = [min(start, own[-1][0]), max(stop, own[-1][1])]
                else:
                    own.append([start, stop])
        for n, own in windows.items():
            item, best = self.items[n], None
            for start, stop in own:
                start = max(0, start)
                part = data[start:stop]
                at = part.find(item.data)
                if at < 0 and not item.keeps_grams(part):
                    continue
                distance, end = (0, at + len(item.data)) if at >= 0 else item.distance(part)
                if distance <= item.budget and (best is None or distance < best[0]):
                    best = (distance, start + end)
            if best:
                found.append((item.item_id, best[0], item.budget, min(max(best[1] - 2, 0), len(data) - 2)))
        return sorted(found, key=_first_unknown)


def _first_unknown(hit: tuple) -> tuple:
    return hit[0] is not None, hit[0] or 0, *hit[1:]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for block in range(n):
        yield [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == block).collect()]


def matcher(items: tuple, rate: float) -> Matcher:
    return held(("matcher", items, rate), lambda: Matcher(list(items), rate))


def _ordered(block: list[tuple[int, str]]) -> tuple:
    return tuple(sorted(block, key=lambda x: (x[0] is None, x[0], x[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and test item it holds: ``doc_id, item_id, distance, budget, end``
    (the last in bytes of the folded text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, item_id long, distance long, budget long, end long"
    found = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(_ordered(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = matcher(shared.value, rate)
            for batch in batches:
                made = [(doc_id, *hit) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in own.hits(text.as_py())]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], ["doc_id", "item_id", "distance", "budget", "end"])

        found = found.unionByName(rows.mapInArrow(run, schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns.

    Items beyond one block take a pass each, whose rows are kept in the shared folder, so that a task
    has one automaton.
    """
    spark = docs.sparkSession
    blocks, store = _blocks(benchmark, item_col, item_text), Store(spark, "clean")
    for n, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(_ordered(block))

        @F.pandas_udf("boolean")
        def dirty(texts, shared=shared):
            own = matcher(shared.value, rate)
            return texts.map(lambda t: bool(own.hits(t)))

        docs = (store.keep(docs, f"block-{n}") if n else docs).where(~dirty(F.coalesce(F.col(text_col), F.lit(""))))
    return docs
