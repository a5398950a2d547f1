"""Topic segmentation over chunk vectors, in the manner of text tiling, and topic labels."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.text import capitalise, topic_words
from timeweave.operators.folds import by_stretch, dealt, numbered
from timeweave.operators.joins import as_of

#: Level, strictness of a boundary, and the least seconds between two.
LEVELS = [("coarse", 1.5, 300.0), ("fine", 1.0, 120.0)]
WIDTH = 4


#: Places of a stretch of vectors.
STRETCH = 1024
#: Chunks, about, whose words are counted by a task: a text's words take many times its room in a shuffle, by which
#: Spark would deal them.
COUNTED = 500


def coherences(units: np.ndarray, width: int) -> np.ndarray:
    """For rows of unit vectors in order: how alike the mean of ``width`` rows up to each place and the
    mean of those after it are; with fewer rows at the ends, of these. Sums run in row order."""
    n = len(units)
    left, right, before, after = np.zeros_like(units), np.zeros_like(units), np.zeros(n), np.zeros(n)
    for back in reversed(range(width)):
        left[back:] += units[: n - back]
        before[back:] += 1
    for ahead in range(1, width + 1):
        right[: max(n - ahead, 0)] += units[ahead:]
        after[: max(n - ahead, 0)] += 1
    left, right = left / before[:, None], right / np.maximum(after, 1)[:, None]
    lengths = [np.where(x == 0, 1, x) for x in (np.sqrt((left**2).sum(axis=1)), np.sqrt((right**2).sum(axis=1)))]
    return (left * right).sum(axis=1) / (lengths[0] * lengths[1])


def coherence(chunks: DataFrame, width: int = WIDTH, stretch: int = STRETCH) -> DataFrame:
    """``video_id, position, next_start, n, coherence``: how alike the ``width`` chunks up to each
    place are to those after it; none at the last.

    Places are numbered within bins, and dealt to stretches with ``width`` places of each neighbour, so
    a long video is several tasks and no row carries its neighbours' vectors."""
    rows = numbered(chunks.select("video_id", F.col("position").alias("_place"), "start_s", "embedding"), "_place", stretch).withColumnRenamed("position", "i")
    first, last = F.floor((F.col("i") - width) / stretch), F.floor((F.col("i") + width) / stretch)
    dealt_ = rows.withColumn("stretch", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    made = pa.schema([("video_id", pa.int64()), ("stretch", pa.int64()), ("rows", pa.list_(pa.struct([("i", pa.int64()), ("position", pa.int64()), ("next_start", pa.float64()), ("coherence", pa.float64())])))])

    def fold(own: list[tuple]) -> tuple:
        units = np.array([r[4] for r in own], np.float64)
        norms = np.sqrt((units**2).sum(axis=1, keepdims=True))
        found = coherences(units / np.where(norms == 0, 1, norms), width).tolist()
        mine = own[0][0]
        return ([{"i": r[1], "position": r[2], "next_start": after[3], "coherence": c} for r, after, c in zip(own, own[1:], found, strict=False) if r[1] // stretch == mine],)

    # each row has its stretch twice: as the key, and for the fold to know its own places
    sorted_ = dealt(dealt_.select("video_id", "stretch", F.col("stretch").alias("mine"), "i", F.col("_place").alias("position"), F.col("start_s").cast("double"), F.col("embedding").cast("array<double>")), ["i"])
    found = sorted_.mapInArrow(by_stretch(fold, made), "video_id long, stretch long, rows array<struct<i:long,position:long,next_start:double,coherence:double>>")
    sizes = rows.groupBy("video_id").agg(F.count("*").alias("n"))
    return found.select("video_id", F.inline("rows")).join(sizes, "video_id").select("video_id", "position", "next_start", "n", "coherence")


def depth(coherent: DataFrame) -> DataFrame:
    """Adds ``depth``: the climbs from each place to the peaks at its two sides. On the way to a peak
    the values do not fall, so the peak is the far end of the run that the place is in."""
    order = Window.partitionBy("video_id").orderBy("position")
    c = F.col("coherence")
    runs = coherent.withColumns({
        "_l": F.sum(F.when(F.lag(c).over(order) >= c, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_r": F.sum(F.when(F.lead(c).over(order) >= c, 0).otherwise(1)).over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    left = F.max(c).over(Window.partitionBy("video_id", "_l"))
    right = F.max(c).over(Window.partitionBy("video_id", "_r"))
    return runs.withColumn("depth", (left - c) + (right - c)).drop("_l", "_r")


def candidates(deep: DataFrame, levels: list = LEVELS, width: int = WIDTH) -> DataFrame:
    """Places deep enough to be boundaries, for each level: deeper than the mean by so many standard
    deviations, and no shallower than their neighbours."""
    own, order = Window.partitionBy("video_id"), Window.partitionBy("video_id").orderBy("position")
    d = F.col("depth")
    marked = deep.withColumns({"_mean": F.avg(d).over(own), "_std": F.stddev_pop(d).over(own), "_peak": (d >= F.coalesce(F.lag(d).over(order), d)) & (d >= F.coalesce(F.lead(d).over(order), d))})
    table = deep.sparkSession.createDataFrame(levels, "level string, k double, least_s double")
    each = marked.where(F.col("_peak") & (F.col("n") >= 2 * width)).join(F.broadcast(table))  # a row a level
    return each.where(d > F.col("_mean") + F.col("k") * F.col("_std")).select("level", "least_s", "video_id", "position", "next_start", "depth")


def spaced(found: DataFrame) -> DataFrame:
    """The strongest boundaries that lie far enough from all stronger ones. Boundaries decide on each
    other only where a chain of them has no gap, so each such chain is a group of its own."""
    order = Window.partitionBy("level", "video_id").orderBy("next_start", "position")
    gap = F.col("next_start") - F.lag("next_start").over(order)
    chain = F.sum(F.when(gap < F.col("least_s"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("chain", chain).select("level", "video_id", "chain", "depth", "position", "next_start", "least_s")
    made = pa.schema([("level", pa.string()), ("video_id", pa.int64()), ("chain", pa.int64()), ("kept", pa.list_(pa.struct([("position", pa.int64()), ("strength", pa.float64())])))])

    def fold(own: list[tuple]) -> tuple:
        times: list[float] = []
        kept = []
        for depth, position, at, least in sorted(own, key=lambda r: (-r[0], r[1])):
            place = bisect_left(times, at)
            if all(abs(t - at) >= least for t in times[max(place - 1, 0) : place + 1]):
                times.insert(place, at)
                kept.append({"position": position, "strength": depth})
        return (kept,)

    grouped = rows.repartition("level", "video_id", "chain").sortWithinPartitions("level", "video_id", "chain")
    return grouped.mapInArrow(by_stretch(fold, made, keys=3), "level string, video_id long, chain long, kept array<struct<position:long,strength:double>>").select("level", "video_id", F.inline("kept"))


def spans(chunks: DataFrame, boundaries: DataFrame, levels: list = LEVELS) -> DataFrame:
    """Chunks with ``level``, ``topic`` (number in the video) and the boundary's strength: a boundary
    begins a topic at the next chunk."""
    table = chunks.sparkSession.createDataFrame([(x[0],) for x in levels], "level string")
    begins = boundaries.select("level", "video_id", (F.col("position") + 1).alias("position"), "strength")
    marked = chunks.join(F.broadcast(table)).join(begins, ["level", "video_id", "position"], "left")  # a row a level
    order = Window.partitionBy("level", "video_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("topic", F.sum(F.when(F.col("strength").isNotNull(), 1).otherwise(0)).over(order))


def labels(parts: DataFrame, keys: list[str], group: list[str], top: int = 6) -> DataFrame:
    """``keys, keywords``: the most distinctive words of each span. ``parts`` are (keys, at, text) in
    order of ``at``, a whole number; ``group`` (some of the keys) is what spans are compared within."""
    words = parts.select(*keys, "at", F.posexplode(topic_words(F.col("text"))).alias("i", "word"))
    first = F.col("at").cast("long") * (1 << 32) + F.col("i")  # a number, so that words are counted without a sort of all
    counted = words.groupBy(*keys, "word").agg(F.count("*").alias("freq"), F.min(first).alias("first"))
    n_spans = parts.select(*keys).distinct().groupBy(*group).agg(F.count("*").alias("spans"))
    length, spans_with = Window.partitionBy(*keys), Window.partitionBy(*group, "word")
    scored = counted.join(n_spans, group).withColumns({"length": F.sum("freq").over(length), "df": F.count("*").over(spans_with)})
    share = F.col("freq") / F.col("length")
    special = F.when((F.col("freq") > 1) & (F.col("spans") > 1), share * F.log((F.col("spans") + 1) / (F.col("df") + 1)))
    scored = scored.withColumns({"special": special, "best": F.max(special).over(length), "share": share})
    score = F.when(F.coalesce(F.col("best") > 0, F.lit(False)), F.col("special")).otherwise(F.col("share"))
    ranked = scored.withColumn("score", score).where("score > 0").withColumn("place", F.row_number().over(length.orderBy(F.desc("score"), "first"))).where(F.col("place") <= top)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w")).select(*keys, F.col("w.word").alias("keywords"))


def title_of(keywords: Column, number: Column) -> Column:
    named = F.array_join(F.transform(F.slice(keywords, 1, 3), capitalise), ", ")
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, named).otherwise(F.format_string("Section %d", number + 1))


def build_topics(chunks: DataFrame, levels: list = LEVELS) -> DataFrame:
    """``level, video_id, topic, start_s, end_s, title, keywords, strength``; chunks are (video_id,
    position, start_s, end_s, text, embedding)."""
    found = spaced(candidates(depth(coherence(chunks)), levels))
    placed = spans(chunks.select("video_id", "position", "start_s", "end_s", "text"), found, levels)
    keys = ["level", "video_id", "topic"]
    tasks = -(-chunks.count() // COUNTED) or 1
    named = labels(placed.repartition(tasks, "video_id").select(*keys, F.col("position").alias("at"), "text"), keys, ["level", "video_id"])
    bounds = placed.groupBy(*keys).agg(F.min("start_s").alias("start_s"), F.max_by("end_s", "position").alias("end_s"), F.round(F.coalesce(F.max("strength"), F.lit(0.0)), 4).alias("strength"))
    return bounds.join(named, keys, "left").select(*keys, "start_s", "end_s", title_of(F.col("keywords"), F.col("topic")).alias("title"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "strength")


def hierarchy(topics: DataFrame) -> DataFrame:
    """Fine topics with the coarse one that holds their middle (``parent``)."""
    coarse = topics.where("level = 'coarse'").select("video_id", "start_s", F.col("topic").alias("topic_id"))
    return as_of(topics.where("level = 'fine'"), coarse, (F.col("start_s") + F.col("end_s")) / 2, to="parent")


def topic_changes(topics: DataFrame) -> DataFrame:
    confidence = F.round(F.least(F.col("strength") * 2, F.lit(1.0)), 3)
    return topics.where("level = 'coarse' and topic > 0").select("video_id", F.lit("topic_change").alias("type"), F.lit("model").alias("source"), "start_s", "end_s", F.substring("title", 1, 512).alias("title"), confidence.alias("confidence"))


def tree(topics: DataFrame) -> DataFrame:
    """``video_id, topic, title, children``: coarse topics with the titles of their fine ones in order."""
    own = hierarchy(topics).groupBy("video_id", "parent").agg(F.array_sort(F.collect_list(F.struct("start_s", "title"))).alias("c"))
    coarse = topics.where("level = 'coarse'").select("video_id", "topic", "title")
    return coarse.join(own.withColumnRenamed("parent", "topic"), ["video_id", "topic"], "left").select("video_id", "topic", "title", F.coalesce(F.col("c.title"), F.array().cast("array<string>")).alias("children"))
