"""Size-aware heavy-light join of word n-gram sets by Jaccard similarity, and its components.

A document's set holds the 64-bit hashes of its distinct shingles. Two sets link when ``den`` times
their intersection is at least ``num`` times their union. The join never looks at pairs of all
sets, yet loses no link:

1. *Lists.* With t = ceil(num n / den), two linked sets share t shingles of the larger one at
   least. Each set lists its q smallest hashes: about twice the n - t that it may have for itself,
   and 160 at least (or all it has). So linked sets have s = q - n + t or more common in their
   lists, with s of the larger one. Copies within a task list once.
2. *Rare first.* A shingle's frequency is counted over all lists. As linked sets share at least s'
   of their lists (s' the least s of the sizes from the own one up that could link), each needs
   only its q - s' + c rarest to share c of them. Shingles that occur once are among these and drop
   out, so a document of which most is its own needs no key, however common its other passages are.
3. *Light sets: subsets.* Sets below a size boundary are keyed by all subsets of c = 2 of these
   shingles, which few unrelated sets share. *Heavy sets: inverted lists.* Sets above it (and those
   below that could link to one above) are keyed by single shingles. The boundary is that of the
   least cost, summed over all sets: a subset costs a row; a list entry a row too, and a share of
   the comparison of whole sets that it is likelier to bring about.
4. *Stars.* Of buckets that hold the same sets one stays. In each bucket every set is compared with one
   of them, the pivot, not with all others. The links found give components, and the pivot, which is
   done, leaves the bucket. Buckets whose sets are still in different components get another pivot,
   while all pairs in them would be many and pivots find links, for ``ROUNDS`` rounds at most; then only
   sets of one bucket that are in different components are compared, if their sizes and parities of
   shingle counts allow a link, and in the largest of the buckets that both name. A group of near copies
   so costs a row a member and round. Links are looked at as links between the components known so far,
   so that no round hands on more of them.
5. Every comparison is of whole sets.

Defined results: null or empty text, or text without words, has an empty set and links with
nothing. A text of fewer words than ``k`` has one shingle, all of it. Rows are documents, also where
ids repeat or are null; the component's id is the least id in it (its own for an empty set).
Columns besides id and text are not read. Intermediate tables go to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.common import Memo, Store, small_batches
from timeweave.llm.components import components, follow

SETS = "row long, doc_id long, text_hash long, n long, key binary, list array<long>, sketch array<long>, wide array<long>"
#: Sizes that the boundary is chosen from: 1, and from 8 to 512 by steps of a fifth.
BOUNDARIES = [1, *sorted({round(8 * 1.189207**i) for i in range(25)})]
#: Shingles that a set lists at least, if it has as many.
LISTED = 160
#: Shingles that take the room of a row, as two exchanges hold it.
COMPARED = 16
#: Rounds of stars at most, and the pairs a row in the open buckets from which on another round is worth it.
ROUNDS, FEW = 8, 8
#: Comparisons with pivots for each link found from which on another round is not worth it.
RARE = 50
#: Buckets that a set names at most, its largest ones, for its pairs not to be compared in others as well.
NAMED = 8
#: Classes of hashes whose parities are kept of each set, and of those of ``LARGE`` shingles or more, which fill the few.
CLASSES, WIDE, LARGE = 512, 4096, 512
MAX_WORDS, MAX_SEEN = 100_000, 300_000


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, k: int):
        self.k = k
        self.words = Memo(xxhash.xxh3_64_intdigest, MAX_WORDS)

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
        k = min(self.k, len(words))
        if not k:
            return np.empty(0, np.uint64)
        each = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        h = np.full(len(words) - k + 1, k, np.uint64)
        for j in range(k):
            h = (h ^ each[j : len(words) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(h ^ (h >> np.uint64(32)))


def parities(found: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """For each of so many classes of hashes, whether the set has an odd number: a bit each, as longs."""
    odd = np.bincount((found & np.uint64(classes - 1)).astype(np.intp), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def could_link(a: Column, b: Column, n: Column, num: int, den: int, classes: int = CLASSES) -> Column:
    """False only for sets that differ in too many shingles, of which each changes one parity. ``n`` is
    the sum of the sizes. Null where a set has no such parities."""
    if classes <= CLASSES:
        differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, classes // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))
    else:  # so long a sum would be too large a method to be compiled
        differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ * (den + num) <= n * (den - num)


def shared(n: int, num: int, den: int) -> int:
    """t: how many of its n shingles a set shares with any set it links to."""
    return -(-num * n // den)


def listed(n: int, num: int, den: int) -> int:
    """q: how many of its smallest hashes a set lists."""
    return min(n, max(2 * (n - shared(n, num, den)) + 1, LISTED))


def common(n: Column, num: int, den: int) -> Column:
    """s' of a set of n: what its list has in common with that of any set it links to, at least."""

    def s(m: Column) -> Column:
        t = F.ceil(m * num / den).cast("long")
        return F.least(m, F.greatest(2 * (m - t) + 1, F.lit(LISTED))) - m + t

    # s rises up to LISTED, falls until 2 (n - t) + 1 passes it, and rises again
    most = F.floor(n * den / num).cast("long")
    low, high = (LISTED // 2 - 2) * den // (den - num), (LISTED // 2 + 2) * den // (den - num)
    return F.least(s(n), s(most), F.when((n <= high) & (most >= low), F.lit(LISTED // 2)))


def shingle_sets(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each row of ``docs``; the first copy in a task has the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, row = Shingler(k), set(), TaskContext.get().partitionId() << 36
        for batch in batches:
            own.words.age()
            rows, sizes, keys, lists, sketches, wide = [], [], [], [], [], []
            for text in batch.column(2):
                found = own.shingles(text.as_py())
                n = len(found)
                key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                new = n and key not in seen
                if new:
                    if len(seen) >= MAX_SEEN:
                        seen.clear()
                    seen.add(key)
                rows.append(row)
                sizes.append(n)
                keys.append(key)
                lists.append(found[: listed(n, num, den)].view(np.int64) if new else None)
                sketches.append(parities(found) if new else None)
                wide.append(parities(found, WIDE) if new and n >= LARGE else None)
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]
            made = [pa.array(c, t) for c, t in zip((rows, sizes, keys, lists, sketches, wide), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([made[0], batch.column(0), batch.column(1), *made[1:]], ["row", "doc_id", "text_hash", "n", "key", "list", "sketch", "wide"])

    return _texts(docs, id_col, text_col).mapInArrow(run, SETS)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def rare_entries(sets: DataFrame, num: int, den: int, store: Store) -> DataFrame:
    """``row, n, token, df, rank, kept``: the list entries that occur more than once, of sets that
    could link, rarest first; ``kept`` of each set are needed for one in common."""
    lists = sets.where(F.col("list").isNotNull()).select("row", "n", F.explode("list").alias("token"))
    counted = lists.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    entries = store.keep(counted, "entries")
    least = common(F.col("n"), num, den)
    own = Window.partitionBy("row")
    ranked = entries.withColumn("rank", F.row_number().over(own.orderBy("df", "token"))).withColumn("kept", F.count("*").over(own) - least + 1)
    return ranked.where("rank <= kept + 1 and kept > 0")


def boundary(entries: DataFrame, num: int, den: int) -> int:
    """The size below which sets are keyed by subsets, of the least cost over all sets."""
    size = F.coalesce(*[F.when(F.col("n") < b, F.lit(b)) for b in BOUNDARIES[1:]], F.lit(1 << 60))
    pairs = (F.col("kept") + 1) * F.col("kept") / 2
    costs = entries.where("rank <= kept").groupBy(size.alias("below")).agg(F.sum(1 + F.col("n") / COMPARED).alias("scan"), F.sum(F.when(F.col("rank") == 1, pairs)).alias("subsets"))
    found = [(r["below"], r["scan"], r["subsets"] or 0) for r in costs.collect()]  # a row a size class
    cost = lambda x: sum(s for b, _, s in found if b <= x) + sum(c for b, c, _ in found if b > shared(x, num, den))
    return min(BOUNDARIES, key=cost)


def keyed(entries: DataFrame, limit: int, num: int, den: int) -> DataFrame:
    """``bucket, row, n``: light sets by subsets of two, heavy ones by single shingles."""
    tiny = next(m for m in range(1, 10_000) if shared(m, num, den) >= 2)  # linked sets have two in common from here on
    n = F.col("n")
    single = (n < tiny) | (n >= shared(limit, num, den))
    lists = entries.where(single & (F.col("rank") <= F.col("kept"))).select(F.xxhash64(F.lit(1), "token").alias("bucket"), "row", "n")
    if limit <= tiny:
        return lists
    light = entries.where((n >= tiny) & (n < limit)).groupBy("row", "n").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    first = light.select("row", "n", "tokens", F.posexplode("tokens").alias("i", "x"))
    both = first.select("row", "n", "x", F.explode(F.expr("slice(tokens, i + 2, size(tokens))")).alias("y"))
    return lists.unionByName(both.select(F.xxhash64(F.lit(2), "x", "y").alias("bucket"), "row", "n"))


def distinct_buckets(placed: DataFrame) -> DataFrame:
    """``placed`` without buckets of one row, or of the same rows as another: a passage that some sets
    share has a bucket for each of its shingles."""
    same = [F.bit_xor(F.xxhash64(F.lit(i), "row")).alias(f"same_{i}") for i in range(2)]
    of = placed.groupBy("bucket").agg(F.count("*").alias("size"), *same).where("size > 1")
    kept = of.groupBy("size", "same_0", "same_1").agg(F.min("bucket").alias("bucket"))
    return placed.join(kept.select("bucket"), "bucket", "left_semi")


def named_buckets(placed: DataFrame) -> DataFrame:
    """``placed`` with ``place``, which orders the buckets by size, and ``named``, the first of the row's."""
    sized = placed.join(placed.groupBy("bucket").agg(F.struct((-F.count("*")).alias("size"), F.col("bucket").alias("b")).alias("place")), "bucket")
    return sized.join(sized.groupBy("row").agg(F.slice(F.array_sort(F.collect_list("place")), 1, NAMED).alias("named")), "row")


def apart(placed: DataFrame) -> DataFrame:
    """``bucket, size`` of the buckets whose sets are still in different components."""
    return placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket", "size")


def pivoted(placed: DataFrame, n: int) -> DataFrame:
    """The sets of open buckets, but for each bucket's pivot of this round, with it. Counted, compared and
    joined where one exchange has dealt them."""
    placed = placed.repartition("bucket")
    pivot = F.min(F.struct(F.xxhash64(F.lit(n), "row").alias("order"), "row", "n", "root")).alias("pivot")
    of = placed.groupBy("bucket").agg(pivot, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return placed.join(of.select("bucket", "pivot"), "bucket").where("row <> pivot.row")


def fits(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def whole_sets(docs: DataFrame, sets: DataFrame, rows: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``row, tokens`` (binary) of the wanted rows, from their whole texts."""
    wanted = sets.join(rows, "row").select("row", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "key")
    texts = _texts(docs, id_col, text_col)
    found = texts.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))).select("row", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(k)
        for batch in batches:
            own.words.age()
            made = [own.shingles(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["row", "tokens"])

    return found.mapInArrow(run, "row long, tokens binary").dropDuplicates(["row"])


def linked(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b, root_a, root_b) whose whole sets link: the distinct pairs of their roots."""
    left, right = whole.select(F.col("row").alias("a"), F.col("tokens").alias("x")), whole.select(F.col("row").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("root_a", "root_b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both_have = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * both_have >= num * (len(a) + len(b) - both_have))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, text_hash, n_shingles, component_id`` and ``root`` (the
    component's key, null for an empty set). Links are not counted: those within one component that
    were not needed to find it are never looked at."""
    with small_batches(docs.sparkSession):
        return _join(docs, k, num, den, id_col, text_col)


def _join(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    store = Store(spark, "jaccard")
    sets = store.keep(shingle_sets(docs, k, num, den, id_col, text_col), "sets")
    ranked = store.keep(rare_entries(sets, num, den, store), "ranked")
    store.drop("entries")
    buckets = store.keep(keyed(ranked, boundary(ranked, num, den), num, den), "buckets")
    store.drop("ranked")

    placed = store.keep(distinct_buckets(buckets).withColumn("root", F.col("row")), "placed-0")
    store.drop("buckets")
    whole = store.keep(whole_sets(docs, sets, placed.select("row").distinct(), k, id_col, text_col), "whole")

    # copies that different tasks have listed
    named = sets.where(F.col("list").isNotNull()).select("row", "key")
    copies = named.groupBy("key").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least < most")
    links = named.join(copies, "key").select(F.col("least").alias("a"), F.col("row").alias("b")).where("a <> b")
    roots = spark.createDataFrame([], "node long, root long")

    for n in range(ROUNDS):
        dealt = store.keep(pivoted(placed, n), f"dealt-{n}")
        tried = dealt.where((F.col("root") != F.col("pivot.root")) & fits(F.col("n"), F.col("pivot.n"), num, den))
        tried = tried.select(F.col("pivot.row").alias("a"), F.col("row").alias("b"), F.col("pivot.root").alias("root_a"), F.col("root").alias("root_b")).distinct()
        tried = store.keep(tried, f"tried-{n}")
        found = store.keep(linked(tried, whole, num, den), f"found-{n}")
        moved = components(links.unionByName(found), store, f"star-{n}")
        roots, links = store.keep(follow(roots, moved).unionByName(moved), f"roots-{n}"), links.limit(0)
        placed = store.keep(follow(dealt.select("bucket", "row", "n", "root"), moved), f"placed-{n + 1}")
        pairs, size = F.col("size") * (F.col("size") - 1) / 2, F.col("size")
        sizes = apart(placed).agg(F.sum(size), F.sum(pairs)).first()
        enough = not sizes[0] or sizes[1] <= FEW * sizes[0] or found.count() * RARE < tried.count()
        store.only("sets", "whole", f"placed-{n + 1}", f"roots-{n}")
        if enough:
            break
    placed = store.keep(distinct_buckets(placed.join(apart(placed).select("bucket"), "bucket", "left_semi")), "placed")

    # sets of one bucket that are still apart
    open_ = store.keep(named_buckets(placed).join(sets.select("row", "sketch", "wide"), "row"), "open")
    a, b = (open_.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("row", "n", "root", "place", "named", "sketch", "wide")]) for s in "ab")
    near = fits(F.col("n_a"), F.col("n_b"), num, den)
    for c, classes in (("sketch", CLASSES), ("wide", WIDE)):
        near &= F.coalesce(could_link(F.col(f"{c}_a"), F.col(f"{c}_b"), F.col("n_a") + F.col("n_b"), num, den, classes), F.lit(True))
    near &= ~F.exists(F.array_intersect("named_a", "named_b"), lambda x: x < F.col("place_a"))
    rest = a.join(b, (a["bucket"] == b["bucket"]) & (F.col("row_a") < F.col("row_b")) & (F.col("root_a") != F.col("root_b")) & near)
    rest = rest.select(F.col("row_a").alias("a"), F.col("row_b").alias("b"), "root_a", "root_b").distinct()
    moved = components(store.keep(linked(rest, whole, num, den), "late"), store, "last")
    roots = follow(roots, moved).unionByName(moved)

    of_key = named.join(roots, F.col("row") == F.col("node"), "left").groupBy("key").agg(F.min(F.coalesce("root", "row")).alias("root"))
    least = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    of_key = of_key.join(least, "key")
    ids = of_key.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = store.keep(of_key.join(ids, "root").select("key", "component_id", "root"), "components")
    store.only("sets", "components")  # which the result reads
    return sets.select("doc_id", "text_hash", "n", "key").join(of_key, "key", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root"
    )


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of least id (then of
    least text hash, then any of rows that repeat both). Rows without words all stay. Columns of
    ``docs`` may have any names; all are given back."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"), own)
    of_rows = join(docs, k, num, den, id_col, text_col).where("root is not null")
    chosen = of_rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select(F.col("row.doc_id").alias("kept_id"), F.col("row.text_hash").alias("kept_hash"))
    kept = rows.where("words").join(chosen, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(1)))
    once = kept.withColumn("place", first).where("place = 1").select("own")
    return rows.where("not words").select("own").unionByName(once).select("own.*")


#: The components of four-word shingle sets at a similarity of 0.85 by SQL, from all pairs that share
#: a shingle.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' '))) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""
