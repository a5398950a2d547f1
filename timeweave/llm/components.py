"""Connected components of a table of links, by alternating star contractions.

Each task first replaces its links, so many at a time, by those of each node to the least one that they
reach. Where no more are left than that, one more such pass ends it without a shuffle; else star steps go on
until they change nothing or so few are left. A large-star step links the greater neighbours of each node to its least neighbour, a small-star
step the lesser ones; the two leave components as they are and shrink them to stars around their
least nodes in a logarithmic number of rounds. Each step is an aggregation and a join on the node,
so no neighbourhood is gathered in one place, and each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import Store

#: Links that a task contracts at once.
HELD = 100_000


def _contracted(edges: DataFrame, held: int) -> DataFrame:
    """The links of each task, ``held`` at a time, as stars: each node and the least that they reach from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        def stars() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([root(u) for u in above], pa.int64())], ["u", "v"])

        n = 0
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = root(u), root(v)
                if u != v:
                    above[max(u, v)] = min(u, v)
            n += batch.num_rows
            if n >= held:
                yield stars()
                above.clear()
                n = 0
        yield stars()

    return edges.mapInArrow(run, "u long, v long")


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "least").alias("least"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "u").where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def follow(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """``rows`` with each root that ``moved`` (node, root) has moved replaced."""
    to = moved.select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    return rows.join(to, F.col("root") == F.col("_from"), "left").withColumn("root", F.coalesce("_to", "root")).drop("_from", "_to")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame, store: Store, name: str, held: int = HELD) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b) but the roots, the least of each component."""
    edges = store.keep(_contracted(links.select(F.col("a").alias("u"), F.col("b").alias("v")), held), f"{name}-0")
    state, n = _state(edges), 0
    while state[0]:
        n += 1
        last = state[0] <= held
        edges = store.keep(_contracted(edges.coalesce(1), held) if last else _small_star(_large_star(edges)), f"{name}-{n}")
        store.drop(f"{name}-{n - 1}")
        if last:
            break
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
