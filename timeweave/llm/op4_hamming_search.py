"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of any number of bits is an array of 64-bit words. It is cut into m segments, none across
words, and each distinct code has a posting for each segment's value. If all segment values within r
bits of a query's have been looked up, every code within m (r + 1) - 1 bits of the query has been
met, as otherwise each of its m segments would differ in more than r bits. So the radius r grows from
0, every code met is verified by its whole distance, and a query is done once its k nearest so far
lie within the covered distance: nothing nearer can be left. Queries that are done leave the next
round. m is chosen so that a segment has about as many values as there are codes.

The values within r bits of a query's segment are made where the query is, by r generators that set
one bit each, every one above the last: no list of masks is made on the driver or broadcast.

Rows of equal codes share one posting with their k + 1 least ids, as no more of them can be among
the k nearest; a code that very many rows share is no hot bucket. Rounds go to the shared folder and
are dropped; the result stays there.

Defined results: rows with a null vector or id are not found and ask nothing. Neighbours exclude
the row itself, order by distance, then id; with fewer than k other rows all are returned. Repeated
ids count once for each code. A vector shorter than the width has zeros at its end; a longer one is
an error. Columns but the id and the code are not read, and may have any names.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.common import Store

WORD = 64


def sign_code(vector: Column, bits: int = WORD) -> Column:
    """The signs of a vector of up to ``bits`` numbers as an array of longs, null for a null vector."""

    def word(at: int) -> Column:
        own = F.transform(F.slice(vector, at + 1, WORD), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.expr("1L"), i.cast("int"))).otherwise(F.expr("0L")))
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, bit: total.bitwiseOR(bit))

    whole = F.array(*[word(at) for at in range(0, max(bits, 1), WORD)])
    longer = F.raise_error(F.format_string("a vector of %d numbers in codes of %d bits", F.size(vector), F.lit(bits)))
    return F.when(F.size(vector) > bits, longer.cast("array<long>")).when(vector.isNotNull(), whole)


class Segments:
    """Where the segments of codes of ``words`` words lie: about ``bits`` bits each."""

    def __init__(self, words: int, bits: float, count: int | None = None):
        each = min(16, max(1, round((count or 64 * words / bits) / words)))
        self.ends = [(w, WORD * i // each, WORD * (i + 1) // each) for w in range(words) for i in range(each)]
        self.widest = max(b - a for _, a, b in self.ends)

    def values(self, code: Column) -> Column:
        """``segment, width, value`` of each segment."""
        made = []
        for n, (w, a, b) in enumerate(self.ends):
            value = F.shiftrightunsigned(code[w], a)
            value = value.bitwiseAND(F.lit((1 << (b - a)) - 1)) if b - a < WORD else value
            made.append(F.struct(F.lit(n).alias("segment"), F.lit(b - a).alias("width"), value.alias("value")))
        return F.inline(F.array(*made))

    def covered(self, radius: int) -> int:
        return len(self.ends) * (radius + 1) - 1


def within(placed: DataFrame, radius: int) -> DataFrame:
    """``query, segment, value`` for all values that differ in ``radius`` bits from those of ``placed``."""
    rows = placed.where(F.col("width") >= radius).select("query", "segment", "width", "value", F.lit(-1).alias("last"))
    for left in reversed(range(radius)):  # bits still to set above this one
        bit = F.explode(F.sequence(F.col("last") + 1, F.col("width") - 1 - left)).alias("bit")
        rows = rows.select("query", "segment", "width", "value", bit)
        rows = rows.select("query", "segment", "width", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, bit)")).alias("value"), F.col("bit").alias("last"))
    return rows.select("query", "segment", "value")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", code_col: str = "code", bits: int = WORD, segments: int | None = None) -> DataFrame:
    """``query_id, neighbor_id, distance, rank`` for each row (id, code) of ``queries``; codes are
    arrays of longs of ``bits`` bits."""
    spark = rows.sparkSession
    store, words = Store(spark, "hamming"), -(-max(bits, 1) // WORD)
    known = [F.col(id_col).cast("long").alias("id"), F.col(code_col).cast("array<long>").alias("code")]
    present = rows.select(*known).where("id is not null and code is not null")
    asked = store.keep(queries.select(*known).where("id is not null and code is not null").distinct(), "asked")
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    least = present.distinct().withColumn("n", first).where(F.col("n") <= k + 1)
    codes = store.keep(least.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    cut = Segments(words, max(4.0, log2(max(codes.count(), 2))), segments)
    postings = store.keep(codes.select("code", F.size("ids").alias("n"), F.col("ids")[0].alias("least"), cut.values(F.col("code"))), "postings")
    active = store.keep(asked.select(F.col("code").alias("query")).distinct(), "active-0")
    distance = sum((F.bit_count(F.col("query")[w].bitwiseXOR(F.col("code")[w])) for w in range(1, words)), F.bit_count(F.col("query")[0].bitwiseXOR(F.col("code")[0])))
    best = spark.createDataFrame([], "query array<long>, code array<long>, n int, least long, distance int")
    best_of = Window.partitionBy("query").orderBy("distance", "least")
    done: list[DataFrame] = []
    for radius in range(cut.widest + 1):
        # the planner takes generated rows for as few as those they come from, and would broadcast them
        probes = within(active.select("query", cut.values(F.col("query"))), radius)
        met = probes.hint("merge").join(postings.select("segment", "value", "code", "n", "least"), ["segment", "value"]).select("query", "code", "n", "least", distance.alias("distance"))
        own = best.join(active, "query", "left_semi") if radius else best
        ranked = own.unionByName(met).distinct().withColumn("place", F.row_number().over(best_of)).where(F.col("place") <= k + 1)
        best = store.keep(ranked.drop("place"), f"best-{radius}")
        if radius == cut.widest:
            done.append(best)
            break
        sure = best.groupBy("query").agg(F.sum(F.when(F.col("distance") <= cut.covered(radius), F.col("n"))).alias("sure")).where(F.col("sure") >= k + 1).select("query")
        done.append(best.join(sure, "query", "left_semi"))
        active = store.keep(active.join(sure, "query", "left_anti"), f"active-{radius + 1}")
        if active.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    near = found.join(codes, "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    each = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(near, "query").where("query_id <> neighbor_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    ranked = each.select("query_id", "neighbor_id", F.col("distance").cast("long").alias("distance"), rank.alias("rank")).where(F.col("rank") <= k)
    result = store.keep(ranked, "result")
    store.only("result")
    return result


#: The same result for the signs of ``embeddings`` by SQL.
SQL = """
WITH codes AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS code FROM embeddings),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, CAST(hamming(q.code, c.code) AS BIGINT) AS distance,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY hamming(q.code, c.code), c.vec_id) AS INTEGER) AS rank
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, neighbor_id, distance, rank FROM ranked WHERE rank <= 10
"""
