"""Exact order statistics of groups of any size: medians and percentiles without a sort of a group.

A group's values are counted in bins between its least and its greatest; the bin that holds the wanted
place is cut in bins again, until few values or one are left in it. Each round is an aggregation to a
row a bin, so a group with most of all rows is counted by all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.sources.scratch import Store

#: Values that are sorted at once, bins of a round, rounds at most, and targets that are sent to all tasks.
FEW, BINS, ROUNDS, SENT = 4096, 256, 16, 10_000


def at_places(rows: DataFrame, key: str, value: str, places: dict[str, Column], few: int = FEW, bins: int = BINS) -> DataFrame:
    """``key, n`` and for each name the value at a place (from 0, a column of the group's size ``n``) of
    the group in ascending order. Null keys and values do not count."""
    store = Store(rows.sparkSession, "places")
    values = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x")).where("k is not null and x is not null")
    sizes = store.keep(values.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")), "sizes")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in places.items()]))
    targets = sizes.withColumn("w", wanted).select("k", "w.name", "w.place", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    ends, wide = ["k", "low", "high"], F.col("high") > F.col("low")
    for n in range(ROUNDS):
        targets = store.keep(targets, f"targets-{n}")
        open_ = targets.where((F.col("inside") > few) & wide)
        intervals = open_.select(*ends).distinct()
        many = intervals.count()
        if not many:
            break
        met = values.join(F.broadcast(intervals) if many <= SENT else intervals, "k").where("x between low and high")
        bin_ = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
        counted = met.groupBy(*ends, bin_.alias("bin")).agg(F.count("*").alias("held"), F.min("x").alias("first"), F.max("x").alias("last"))
        before = F.sum("held").over(Window.partitionBy(*ends).orderBy("bin")) - F.col("held")
        at = open_.join(counted.withColumn("before", before), ends).where("place >= below + before and place < below + before + held")
        narrowed = at.select("k", "name", "place", F.col("first").alias("low"), F.col("last").alias("high"), (F.col("below") + F.col("before")).alias("below"), F.col("held").alias("inside"))
        targets = targets.where(~((F.col("inside") > few) & wide)).unionByName(narrowed)
    intervals = targets.where(wide).select(*ends).distinct()
    met = values.join(F.broadcast(intervals) if intervals.count() <= SENT else intervals, "k").where("x between low and high")
    place = F.row_number().over(Window.partitionBy(*ends).orderBy("x")) - 1
    sorted_ = met.withColumn("own", place)
    found = targets.where(~wide).select("k", "name", F.col("low").alias("x"))
    found = found.unionByName(targets.where(wide).join(sorted_, ends).where("own + below = place").select("k", "name", "x"))
    whole = found.groupBy("k").agg(*[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in places])
    result = store.keep(sizes.select("k", "n").join(whole, "k").withColumnRenamed("k", key), "result")
    store.only("result")
    return result


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], **options) -> DataFrame:
    """``key`` and for each name the percentile (from 0 to 1), between two values in proportion."""
    at = {name: F.lit(share) * (F.col("n") - 1) for name, share in shares.items()}
    places = {f"{name}_{end}": f(x) for name, x in at.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    found = at_places(rows, key, value, places, **options)
    between = lambda name, x: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (x - F.floor(x))
    return found.select(key, *[between(name, x).alias(name) for name, x in at.items()])
