"""Summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.text import strip

# Fixed value: of several events in a slot the first type of this list shows.
PRIORITY = ["topic_change", "text_appeared", "silence", "scene_change", "slide_change"]
SLOTS = 240


def index_stats(chunks: DataFrame) -> DataFrame:
    by_level = chunks.groupBy("level").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"), F.countDistinct("video_id").alias("videos"))
    return by_level.withColumn("searchable", (F.col("level") == "child") & (F.col("embedded") > 0))


def collection_summary(collections: DataFrame, videos: DataFrame, indexed: DataFrame) -> DataFrame:
    """Videos, seconds and indexed videos of each collection; the row without id is what is unfiled."""
    marked = videos.join(indexed.select("video_id").distinct().withColumn("is_indexed", F.lit(1)), "video_id", "left")
    own = marked.groupBy("collection_id").agg(F.count("*").alias("video_count"), F.sum("duration_s").alias("duration_s"), F.count("is_indexed").alias("indexed_count"))
    filed = collections.select("collection_id").unionByName(collections.sparkSession.createDataFrame([(None,)], "collection_id long"))
    joined = filed.alias("c").join(own.alias("o"), F.col("c.collection_id").eqNullSafe(F.col("o.collection_id")), "left")
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z))
    return joined.select("c.collection_id", zero("video_count", 0).alias("video_count"), F.round(zero("duration_s", 0.0), 6).alias("duration_s"), zero("indexed_count", 0).alias("indexed_count"))


def transcript_summary(segments: DataFrame) -> DataFrame:
    """Segments, seconds of speech, and the model that made the first segment."""
    model = F.min_by("model", "position") if "model" in segments.columns else F.lit(None).cast("string")
    return segments.groupBy("video_id").agg(F.count("*").alias("segments"), F.round(F.sum(F.col("end_s") - F.col("start_s")), 2).alias("speech_s"), model.alias("model"))


def library_totals(videos: DataFrame) -> DataFrame:
    """Hours of all videos, and how many of them are ready."""
    return videos.agg(F.round(F.coalesce(F.sum("duration_s"), F.lit(0.0)) / 3600, 6).alias("hours"), F.count_if(F.col("status") == "ready").alias("ready"))


def block_metrics(frames: DataFrame, blocks: DataFrame) -> DataFrame:
    return frames.agg(F.count("*").alias("frames")).join(
        blocks.agg(F.countDistinct("frame_id").alias("frames_with_text"), F.count("*").alias("blocks"), F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("confidence"))
    )


def frame_metrics(frames: DataFrame) -> DataFrame:
    """Frames a minute; recordings under a minute count as one."""
    own = frames.groupBy("video_id").agg(F.count("*").alias("extracted"), F.max("time_s").alias("duration_s"))
    return own.select("video_id", "extracted", F.round(F.col("extracted") / F.greatest(F.col("duration_s") / 60, F.lit(1.0)), 6).alias("per_minute"))


def event_metrics(events: DataFrame, coarse: DataFrame) -> DataFrame:
    """Events by type and in all, with a change for each coarse topic but the first."""
    by_type = events.groupBy("video_id", "type").agg(F.count("*").alias("n"))
    topics = coarse.groupBy("video_id").agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("n")).where("n > 0").select("video_id", F.lit("topic_change").alias("type"), "n")
    return by_type.unionByName(topics).withColumn("total", F.sum("n").over(Window.partitionBy("video_id")))


def job_progress(stages: DataFrame) -> DataFrame:
    """The mean progress of a job's stages; skipped ones are done."""
    return stages.groupBy("seq").agg(F.round(F.coalesce(F.avg(F.when(F.col("status") == "skipped", 1.0).otherwise(F.col("progress"))), F.lit(0.0)), 6).alias("progress"))


def span_text(texts: Column) -> Column:
    """The texts of (position, text) structs, trimmed, without empty ones, in order."""
    clean = F.transform(F.array_sort(texts), lambda x: strip(x["text"]))
    return F.array_join(F.filter(clean, lambda t: t != ""), " ")


def speakers(ids: Column) -> Column:
    """The distinct speakers of an array, sorted, without null."""
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))


def timeline_slots(events: DataFrame, videos: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``video_id, slot, event_id``: what each slot of a time line shows."""
    rank = F.coalesce(*[F.when(F.col("type") == kind, F.lit(i)) for i, kind in enumerate(PRIORITY)], F.lit(len(PRIORITY)))
    slot = F.greatest(F.lit(0), F.least(F.lit(slots - 1), F.floor(F.col("start_s") / F.col("duration_s") * slots)))
    placed = events.join(videos.where("duration_s > 0"), "video_id").select("video_id", slot.alias("slot"), F.struct(rank.alias("rank"), "start_s", "event_id").alias("e"))
    return placed.groupBy("video_id", "slot").agg(F.min("e").alias("e")).select("video_id", "slot", F.col("e.event_id").alias("event_id"))


def chronology(hits: DataFrame, per_video: int = 8, least: float | None = 2.0) -> DataFrame:
    """Where a concept occurs: of each video's relevant hits (query_id, video_id, chunk_id, start_s,
    rank, score) the earliest few; videos by their best score, ties by their first hit."""
    kept = hits if least is None else hits.where(F.col("score") >= least)
    own = Window.partitionBy("query_id", "video_id")
    early = kept.withColumn("place", F.row_number().over(own.orderBy("start_s", "rank"))).withColumn("total", F.count("*").over(own)).where(F.col("place") <= per_video)
    scored = early.withColumns({"best": F.max(F.coalesce("score", F.lit(0.0))).over(own), "first_rank": F.min("rank").over(own)})
    track = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "first_rank", "video_id"))
    return scored.withColumn("track", track).select("query_id", "track", "video_id", "place", "chunk_id", "start_s", "total", "best")
