"""Near-duplicate groups by SimHash and multi-index hashing.

A fingerprint has 64 bits; bit i is set where over half of the 64-bit hashes of a text's word
shingles, repeats included, have it. Fingerprints of at most ``most`` differing bits link. Cut into
m segments, two that link differ in at most r = most // m bits of one segment. So every distinct
fingerprint is filed under its m segment values (a *resident* of m buckets), and visits the buckets
of all values within r bits of its own: the small Hamming balls. For r = 1 it visits only values with
one more bit set, as of two values that differ in one bit the other one comes this way. A bucket is
kept only if it has a resident and another member; with segments of 32 bits, unrelated fingerprints
hardly ever meet.

Fingerprints of a large group of near copies do meet, in very many pairs. So a bucket is first
compared with one of its residents, the pivot: links found give components, and buckets that lie in
one component are done. The others get another pivot, and after ``ROUNDS`` what is still in different
components of one bucket is compared pair by pair within the join, which gives out only pairs that
link and are in different components. No link between different components is lost, as
every pair of a resident and a member is compared, or known to be of one component.

Equal fingerprints are one from the start, so groups of exact copies of any size cost one row. The
result joins documents to components by fingerprint; fingerprints that hold more than a thousandth
of all rows, of which there are a thousand at most, are broadcast, so no key of the shuffled join
has more.

Defined results: null and empty texts, and texts without words, have fingerprint zero, which links
like any other. A text of fewer words than ``k`` has one shingle, all of it. Rows are documents, also
where ids repeat or are null; a component's id is its least id, null if all are null. Columns
besides id and text are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import Store, by_batch, join_by_hot_key
from timeweave.llm.components import components, follow

BITS, SEED = 64, 42
#: Words whose shingles are hashed at once; longer texts carry their counts over.
STEP = 1 << 15
#: Rounds of pivots at most, and members of open buckets that are compared without another.
ROUNDS, FEW = 3, 8
PRINTS = "doc_id long, print long"


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of the shingles of k words, joined by one space."""
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the highest down."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, k: int = 3) -> int:
    """The fingerprint of a text as a signed long. Only A-Z lose their case, and only ASCII white
    space parts words."""
    words = text.lower().split()
    k, n = min(k, len(words)), 0
    if not k:
        return 0
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(words) - k + 1, STEP):
        found = _hashes(words[at : at + STEP + k - 1], k)
        total, n = total + _set_bits(found), n + len(found)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print`` of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def columns(batch: pa.RecordBatch) -> list:
        return [batch.column(0), [fingerprint(t, k) for t in batch.column(1).cast(pa.binary()).to_pylist()]]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(by_batch(columns, schema), PRINTS)


class Cut:
    """m segments of a fingerprint, and the radius within which one of them differs."""

    def __init__(self, most: int, segments: int):
        if not 0 < segments <= BITS or most < 0:
            raise ValueError("segments of a bit at least, and a distance of 0 or more")
        self.most, self.radius = most, most // segments
        edges = [BITS * i // segments for i in range(segments + 1)]
        self.parts = list(zip(edges, edges[1:], strict=False))

    def values(self, code: Column) -> list[tuple[int, int, Column]]:
        """(segment, width, value) of each segment."""
        mask = lambda w: F.lit(-1 if w == BITS else (1 << w) - 1).cast("long")
        return [(n, b - a, F.shiftrightunsigned(code, a).bitwiseAND(mask(b - a))) for n, (a, b) in enumerate(self.parts)]

    def residents(self, codes: DataFrame) -> DataFrame:
        """``segment, value, code``: where each code is filed."""
        each = F.array(*[F.struct(F.lit(n).alias("segment"), v.alias("value")) for n, _, v in self.values(F.col("code"))])
        return codes.select(F.inline(each), "code")

    def visitors(self, codes: DataFrame) -> DataFrame:
        """``segment, value, code``: the other buckets that each code looks into. A generator flips the
        bits one after the other, each above the last; of radius 1 only those that are not set."""
        each = F.array(*[F.struct(F.lit(n).alias("segment"), F.lit(w).alias("width"), v.alias("own")) for n, w, v in self.values(F.col("code"))])
        rows = codes.select(F.inline(each), "code").withColumns({"value": F.col("own"), "last": F.lit(-1)})
        found = rows.select("segment", "value", "code").limit(0)
        unset = "and shiftrightunsigned(own, x) & 1 = 0" if self.radius == 1 else ""
        for _ in range(self.radius):
            rows = rows.select("segment", "width", "own", "code", "value", F.expr(f"explode(filter(sequence(0, width - 1), x -> x > last {unset}))").alias("last"))
            rows = rows.withColumn("value", F.expr("value ^ shiftleft(1L, last)"))
            found = found.unionByName(rows.select("segment", "value", "code"))
        return found


def near(a: Column, b: Column, most: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


BUCKET = ["segment", "value"]


def bucket_members(codes: DataFrame, cut: Cut, store: Store) -> DataFrame:
    """``segment, value, code, home, root``: residents (``home``) and visitors of every bucket that has
    a resident and another member."""
    residents = cut.residents(codes)
    # the planner takes generated rows for as few as those they come from, and would broadcast them
    met = cut.visitors(codes).join(residents.select(*BUCKET).distinct().hint("merge"), BUCKET, "left_semi")
    both = residents.withColumn("home", F.lit(True)).unionByName(store.keep(met, "met").withColumn("home", F.lit(False)))
    open_ = both.groupBy(*BUCKET).agg(F.count("*").alias("size")).where("size > 1")
    return store.keep(both.join(open_.hint("merge"), BUCKET, "left_semi").withColumn("root", F.col("code")), "placed-0")


def star_round(placed: DataFrame, n: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The members but each bucket's pivot, and the links of pivots to them, between components."""
    pivot = F.min(F.when(F.col("home"), F.struct(F.xxhash64(F.lit(n), "code").alias("order"), "code", "root"))).alias("pivot")
    dealt = placed.join(placed.groupBy(*BUCKET).agg(pivot).where("pivot is not null"), BUCKET).where("code <> pivot.code")
    links = dealt.where((F.col("root") != F.col("pivot.root")) & near(F.col("code"), F.col("pivot.code"), most))
    return dealt.select(*BUCKET, "code", "home", "root"), links.select(F.col("pivot.root").alias("a"), F.col("root").alias("b")).distinct()


def still_apart(placed: DataFrame) -> DataFrame:
    """Members of buckets that have a resident left and lie in several components."""
    of = placed.groupBy(*BUCKET).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("home").alias("left")).where("low < high and left")
    return placed.join(of, BUCKET, "left_semi")


def late_links(placed: DataFrame, most: int) -> DataFrame:
    """Links of residents to members of their buckets, between components."""
    a, b = (placed.select(*BUCKET, *[F.col(c).alias(f"{c}_{s}") for c in ("code", "home", "root")]) for s in "ab")
    once = F.col("home_a") & (~F.col("home_b") | (F.col("code_a") < F.col("code_b")))
    both = a.join(b, BUCKET).where(once & (F.col("root_a") != F.col("root_b")) & near(F.col("code_a"), F.col("code_b"), most))
    return both.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()


def group_codes(codes: DataFrame, store: Store, most: int = 3, segments: int = 2) -> DataFrame:
    """``node, root`` of every code that is not the least of its component."""
    placed = bucket_members(codes, Cut(most, segments), store)
    moves = codes.sparkSession.createDataFrame([], "a long, b long")
    for n in range(ROUNDS):
        dealt, links = star_round(placed, n, most)
        moved = store.keep(components(store.keep(links, f"links-{n}"), store, f"star-{n}"), f"moved-{n}")
        moves = moves.unionByName(moved.select(F.col("node").alias("a"), F.col("root").alias("b")))
        placed = store.keep(still_apart(follow(dealt, moved)), f"placed-{n + 1}")
        store.drop(f"placed-{n}", f"links-{n}", "met")
        sizes = placed.groupBy(*BUCKET).agg(F.count("*").alias("size")).agg(F.sum("size"), F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()
        if not sizes[0] or sizes[1] <= FEW * sizes[0]:
            break
    return components(moves.unionByName(store.keep(late_links(placed, most), "late")), store, "last")


def dedup(docs: DataFrame, k: int = 3, most: int = 3, segments: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print, component_id`` of each row."""
    store = Store(docs.sparkSession, "simhash")
    prints = store.keep(fingerprints(docs, k, id_col, text_col), "prints")
    codes = store.keep(prints.groupBy(F.col("print").alias("code")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "codes")
    roots = group_codes(codes.select("code"), store, most, segments).withColumnRenamed("node", "code")
    rooted = store.keep(codes.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code")), "rooted")
    ids = store.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_codes")), "ids")
    named = store.keep(join_by_hot_key(rooted.select("root", F.col("code").alias("print"), "n"), ids, "root", "n_codes").select("print", "component_id", "n"), "named")
    store.only("prints", "named")  # which the result reads
    return join_by_hot_key(prints, named, "print", "n").select("doc_id", "print", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits)``, component_id`` of each row."""
    return dedup(docs).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
