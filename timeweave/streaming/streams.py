"""Structured Streaming forms of the incremental work: catalogue, re-indexing, silences, frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from timeweave.sources.files import catalogue, replace_keys
from timeweave.sources.scratch import exists

#: How long a stream without a table remembers contents.
KEPT = "30 days"


def catalogue_of(arriving: DataFrame) -> DataFrame:
    """Accepted media of a stream of (path, modificationTime, length, content), each content once within
    the time that the watermark keeps: state holds the checksums of so long, and no longer."""
    good, _ = catalogue(arriving.withWatermark("modificationTime", KEPT))
    return good.dropDuplicatesWithinWatermark(["checksum"])


def arriving_files(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The files of a folder as they arrive, without their content: (path, modificationTime, length)."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return rows.option("recursiveFileLookup", "true").options(**options).load(folder).drop("content")


def stream_catalogue(arriving: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the catalogue table at ``path``: accepted media, each content once, ever. The table itself is
    the memory: a batch adds what no other batch has added, under its own number, and takes its own
    place when it runs twice, so a restart adds nothing twice and no state grows."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = catalogue(batch)[0].groupBy("checksum").agg(F.min(F.struct("path", "suffix", "size_bytes", "title", "content_type", "status")).alias("m")).select("checksum", "m.*")
        if exists(spark, path):
            others = spark.read.parquet(path).where(F.col("batch") != number)
            first = first.join(others.select("checksum"), "checksum", "left_anti")
        first.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_reindex(changes: DataFrame, rebuild: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Rebuilds the videos of each batch of changes and replaces their rows in the table at ``path``
    (``files.replace_keys``). As whole videos are replaced, a batch that runs twice does no harm."""

    def run(batch: DataFrame, _: int) -> None:
        videos = batch.select("video_id").distinct()
        replace_keys(batch.sparkSession, rebuild(videos), videos, path)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_sessions(events: DataFrame, gap: str = "20 seconds", late: str = "10 minutes") -> DataFrame:
    """Stretches of events of a video without a gap: silences lie between them."""
    return (
        events.withWatermark("ts", late).groupBy("video_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("video_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


#: Groups of videos whose rows wait together: each call of the state then serves many videos.
GROUPS = 1024


class InOrder(StatefulProcessor):
    """Holds the rows of a group of videos back until the watermark has passed them, and then takes each
    video's in order: rows may come in any order within the time that is allowed. The state is the rows that
    wait, and what ``step`` returns for a video's next ones. Rows are (time_s, ...), after their video in the
    state; a timer wakes a group whose rows wait. Videos without an id have a group of their own."""

    #: Columns of rows, of the state that ``step`` keeps, and of the results.
    ROWS: str
    STATE: str
    RESULTS: list[str]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.kept = (handle.getListState(name, f"video_id long, {columns}") for name, columns in (("waiting", self.ROWS), ("kept", self.STATE)))

    def step(self, video, state: tuple | None, row: tuple, out: list) -> tuple:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["video_id", *(c.split()[0] for c in self.ROWS.split(", "))]
        came = [(None if key[0] < 0 else int(x[0]), *x[1:]) for frame in rows for x in frame[names].itertuples(index=False, name=None)]
        self.waiting.appendList(came)
        earliest = min(x[1] for x in came)
        if earliest < timerValues.getCurrentWatermarkInMs() / 1000:
            yield from self._due(timerValues)
        else:  # nothing new is due; what waited before has its own timer
            self.handle.registerTimer(ceil(earliest * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._due(timerValues)

    def _due(self, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[1:]) if self.waiting.exists() else []
        due, later = [r for r in rows if r[1] < now], [r for r in rows if r[1] >= now]
        if not rows:  # an earlier timer took them
            return
        states, out = {r[0]: tuple(r[1:]) for r in self.kept.get()} if due and self.kept.exists() else {}, []
        for video, *row in due:
            states[video] = self.step(video, states.get(video), tuple(row), out)
        if due:
            self.kept.put([(video, *state) for video, state in states.items()])
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if later:
            self.handle.registerTimer(ceil(later[0][1] * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=self.RESULTS).astype({"video_id": "Int64"})

    def close(self) -> None:
        pass


class FrameSelector(InOrder):
    """Keeps a frame where it differs enough from the last one kept or comes long after it; the state
    of a video is that frame's time and hash."""

    ROWS, STATE, RESULTS = "time_s double, phash long", "time_s double, phash long", ["video_id", "time_s", "phash", "change"]

    def __init__(self, least_s: float = 4.0, most_s: float = 90.0, threshold: int = 10):
        self.least_s, self.most_s, self.threshold = least_s, most_s, threshold

    def step(self, video, state, row, out):
        change = 0
        if state is not None:
            change = ((int(row[1]) ^ int(state[1])) & (1 << 64) - 1).bit_count()
            if row[0] - state[0] < self.least_s or (change < self.threshold and row[0] - state[0] < self.most_s):
                return state
        out.append((video, float(row[0]), int(row[1]), change))
        return float(row[0]), int(row[1])


class SilenceFinder(InOrder):
    """The silences between a video's segments: from the end of one to the start of the next, if so many
    seconds lie between; the state is the end of the last segment."""

    ROWS, STATE, RESULTS = "time_s double, position long, end_s double", "end_s double", ["video_id", "start_s", "end_s"]

    def __init__(self, least_s: float = 20.0):
        self.least_s = least_s

    def step(self, video, state, row, out):
        if state is not None and row[0] - state[0] >= self.least_s:
            out.append((video, float(state[0]), float(row[0])))
        return (float(row[2]),)


def _in_order(rows: DataFrame, late: str, processor: InOrder, schema: str) -> DataFrame:
    timed = rows.withColumn("ts", F.timestamp_micros((F.col("time_s") * 1_000_000).cast("long"))).withWatermark("ts", late)
    group = F.when(F.col("video_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("video_id"), F.lit(GROUPS)).cast("int"))
    return timed.withColumn("group", group).groupBy("group").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def stream_frames(samples: DataFrame, late: str = "10 minutes", **options) -> DataFrame:
    """Frames worth keeping of samples (video_id, time_s, phash) that come at most ``late`` behind others."""
    return _in_order(samples, late, FrameSelector(**options), "video_id long, time_s double, phash long, change long")


def stream_silences(segments: DataFrame, late: str = "10 minutes", least_s: float = 20.0) -> DataFrame:
    """``video_id, start_s, end_s`` of silences between segments (video_id, position, start_s, end_s) that
    come at most ``late`` behind others."""
    rows = segments.select("video_id", F.col("start_s").alias("time_s"), "position", "end_s")
    return _in_order(rows, late, SilenceFinder(least_s), "video_id long, start_s double, end_s double")
