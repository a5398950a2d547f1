"""Retrieval metrics of one ranked list, given as an array of booleans: which ranks are relevant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _window(relevant: Column, k: int) -> Column:
    if k <= 0:
        raise ValueError("k is 1 or more")
    return F.slice(relevant, 1, k)


def _count(relevant: Column) -> Column:
    return F.size(F.filter(relevant, lambda r: r))


def first_rank(relevant: Column) -> Column:
    """The rank of the first relevant result, null without one."""
    return F.nullif(F.array_position(relevant, True), F.lit(0)).cast("long")


def recall(relevant: Column, k: int) -> Column:
    """1 if the first k hold a relevant result: one passage answers a question."""
    return F.when(_count(_window(relevant, k)) > 0, 1.0).otherwise(0.0)


def precision(relevant: Column, k: int) -> Column:
    """The relevant share of the results that are there."""
    own = _window(relevant, k)
    return F.when(F.size(own) == 0, 0.0).otherwise(_count(own) / F.size(own))


def reciprocal_rank(relevant: Column) -> Column:
    return F.coalesce(1.0 / first_rank(relevant), F.lit(0.0))


def average_precision(relevant: Column) -> Column:
    ranked = F.filter(F.transform(relevant, lambda r, i: F.when(r, i + 1)), lambda x: x.isNotNull())
    total = F.aggregate(F.transform(ranked, lambda rank, i: (i + 1) / rank), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(ranked) == 0, 0.0).otherwise(total / F.size(ranked))


def dcg(relevant: Column, k: int) -> Column:
    gains = F.transform(_window(relevant, k), lambda r, i: F.when(r, 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    return F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)


def ndcg(relevant: Column, k: int) -> Column:
    """The ideal has the hits that were found at the front."""
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(_count(relevant), F.lit(1))), lambda i: F.when((i <= k) & (i <= _count(relevant)), 1.0 / F.log2(i + 1.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return F.when(_count(relevant) == 0, 0.0).otherwise(dcg(relevant, k) / ideal)
