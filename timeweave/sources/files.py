"""Files in and out: question sets, media catalogues, captions, reports, and writes that replace."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.functions.text import CONTENT_TYPES, caption, content_type, suffix_of
from timeweave.functions.time import clock
from timeweave.sources.scratch import Store, exists, tidy

SPANS = "array<struct<s:double,e:double>>"
QUESTION = f"id string, question string, category string, video_id string, gold_spans array<array<double>>, gold_start_s double, gold_end_s double, kind string, source_chunk_id string, anchor_s double, verified boolean, note string"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines. Blank lines and unknown fields are skipped, a single span in the old
    fields becomes a list of one; an id that stands twice is an error."""
    try:
        rows = spark.read.schema(QUESTION).json(path)
    except Exception as error:
        raise FileNotFoundError(f"no question set at {path}; build one first") from error
    questions = from_fields(rows.where("id is not null"))
    twice = [r["id"] for r in questions.groupBy("id").count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"ids that stand more than once: {', '.join(twice)}")
    return questions


def from_fields(rows: DataFrame) -> DataFrame:
    old = F.when(F.col("gold_start_s").isNotNull(), F.array(F.struct(F.col("gold_start_s").alias("s"), F.col("gold_end_s").alias("e"))))
    listed = F.transform("gold_spans", lambda g: F.struct(g[0].alias("s"), g[1].alias("e")))
    spans = F.coalesce(listed, old, F.array().cast(SPANS))
    return rows.select("id", "question", "category", "video_id", spans.alias("gold_spans"), "kind", "source_chunk_id", "anchor_s", F.coalesce("verified", F.lit(False)).alias("verified"), "note")


def save_questions(questions: DataFrame, path: str) -> None:
    pairs = F.transform("gold_spans", lambda g: F.array(g["s"], g["e"]))
    questions.withColumn("gold_spans", pairs).write.mode("overwrite").json(path)


#: Bytes that a digest reads at once.
STEP = 4 << 20


def open_file(path: str):
    """A file to read from, wherever it is stored."""
    from pyarrow import fs

    if ":" not in path.partition("/")[0] or path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"))
    system, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(name)


def digests(files: DataFrame, opener: Callable = open_file, step: int = STEP) -> DataFrame:
    """``path, checksum`` (sha256) of files: executors read each path in steps, so a file may have any
    size, and no row holds its content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = []
            for path in frame["path"]:
                digest = hashlib.sha256()
                with opener(path) as file:
                    while part := file.read(step):
                        digest.update(part)
                sums.append(digest.hexdigest())
            yield pd.DataFrame({"path": frame["path"], "checksum": sums})

    return files.select("path").mapInPandas(run, "path string, checksum string")


def catalogue(files: DataFrame, most_bytes: int = 8 << 30, opener: Callable = open_file) -> tuple[DataFrame, DataFrame]:
    """Accepted media (path, suffix, size, checksum, title, content type) and rejects with a reason, from
    (path, length) rows. With a column ``content`` its digest is taken; without, the files are read where
    they lie, accepted ones alone."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    own = [c for c in ("modificationTime", "content") if c in files.columns]
    time = ["modificationTime"] * ("modificationTime" in own)
    marked = files.select("path", name.alias("name"), suffix_of(name).alias("suffix"), F.col("length").alias("size_bytes"), *own)
    reason = F.when(~F.col("suffix").isin(list(CONTENT_TYPES)), "suffix").when(F.col("size_bytes") == 0, "empty").when(F.col("size_bytes") > most_bytes, "too large")
    marked = marked.withColumn("reason", reason)
    title = F.substring(F.regexp_replace("name", r"\.[^.]+$", ""), 1, 512)
    good = marked.where("reason is null")
    good = good.withColumn("checksum", F.sha2("content", 256)) if "content" in own else good.join(digests(good, opener), "path")
    good = good.select("path", "suffix", "size_bytes", "checksum", title.alias("title"), content_type(F.col("name")).alias("content_type"), F.lit("uploaded").alias("status"), *time)
    return good, marked.where("reason is not null").select("path", "size_bytes", "reason")


def copy_new(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The rows whose key the target lacks."""
    return source.join(target.select(key), key, "left_anti")


def copy_tables(sources: dict[str, DataFrame], target: str, keys: dict[str, str]) -> DataFrame:
    """Appends to each table under ``target`` the rows whose key it lacks, and gives ``name, added, total``:
    both numbers are observed as the rows are written. A second run adds nothing."""
    spark, counts = next(iter(sources.values())).sparkSession, []
    for name, source in sources.items():
        key, path = keys[name], f"{target}/{name}"
        known = spark.read.parquet(path).select(key) if exists(spark, path) else source.select(key).limit(0)
        marked = source.join(known.distinct().withColumn("_known", F.lit(True)), key, "left")
        seen = Observation(f"copy-{name}-{uuid.uuid4().hex}")
        watched = marked.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.col("_known").isNull()).alias("added"))
        watched.where("_known is null").drop("_known").select(*source.columns).write.mode("append").parquet(path)
        counts.append((name, int(seen.get["added"]), int(seen.get["total"])))
    return spark.createDataFrame(counts, "name string, added long, total long")


#: Folders of a table whose rows are replaced by key.
BUCKETS = 64


def replace_keys(spark: SparkSession, new: DataFrame, keys: DataFrame, path: str, key: str = "video_id", buckets: int = BUCKETS) -> None:
    """Replaces all rows of ``keys`` in the table at ``path``, whose rows lie in folders by a hash of their
    key. The folders of these keys are read, their rows of other keys kept, and all are overwritten in
    one write; a row without key stands in each, so that a folder which has lost all others is
    overwritten too. ``read_keyed`` leaves these out. No file is deleted by name. Folders are replaced when
    all tasks have written, so the old rows are read while the new ones are written beside them."""
    store = Store(spark, "replace", small=True)
    bucket = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(buckets)).cast("int")
    touched = store.keep(keys.select(key).distinct().withColumn("bucket", bucket), "keys")
    marks = touched.select("bucket").distinct()
    rows = new.withColumn("bucket", bucket)
    if exists(spark, path):
        folders = [r["bucket"] for r in marks.collect()]  # ``buckets`` at most
        old = spark.read.parquet(path).where(F.col("bucket").isin(folders)).where(F.col(key).isNotNull())
        rows = old.join(touched.select(key), key, "left_anti").unionByName(rows)
    empty = marks.select(*[F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns], "bucket")
    united = rows.select(*new.columns, "bucket").unionByName(empty)
    with tidy(spark):
        united.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)
    store.close()


def read_keyed(spark: SparkSession, path: str, key: str = "video_id") -> DataFrame:
    """The rows of a table that ``replace_keys`` keeps."""
    return spark.read.parquet(path).where(F.col(key).isNotNull()).drop("bucket")


def reconcile_frames(old: DataFrame, new: DataFrame) -> DataFrame:
    """What becomes of each frame: those with the same start (to a hundredth) and hash keep their id,
    others are inserted or deleted."""
    key = [F.col("video_id"), F.round("start_s", 2).alias("at"), F.col("phash")]
    a, b = old.select(*key, "frame_id"), new.select(*key, F.col("position").alias("new_position"), F.col("end_s").alias("new_end"))
    both = a.withColumn("_old", F.lit(True)).join(b.withColumn("_new", F.lit(True)), ["video_id", "at", "phash"], "full_outer")
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("keep")
    return both.select("video_id", "at", "phash", "frame_id", "new_position", "new_end", action.alias("action"))


def cues(segments: DataFrame, kind: str, link: str | None = None) -> DataFrame:
    """``video_id, content``: a caption file of each video, as srt, vtt, txt or md."""
    end = F.when(F.col("end_s") <= F.col("start_s"), F.col("start_s") + 0.5).otherwise(F.col("end_s"))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("start_s", "end_s", "position"))
    rows = segments.withColumn("end_s", end).withColumn("n", number)
    text, said = caption(F.col("text")), F.when(F.col("speaker_id").isNotNull(), F.concat(F.lit("**"), F.col("speaker_id"), F.lit(":** "))).otherwise("")
    if kind == "srt":
        part = F.concat(F.col("n").cast("string"), F.lit("\n"), clock(F.col("start_s"), ","), F.lit(" --> "), clock(F.col("end_s"), ","), F.lit("\n"), text, F.lit("\n"))
        head, join = "", "\n"
    elif kind == "vtt":
        part = F.concat(clock(F.col("start_s"), "."), F.lit(" --> "), clock(F.col("end_s"), "."), F.lit("\n"), text, F.lit("\n"))
        head, join = "WEBVTT\n\n", "\n"
    elif kind == "txt":
        part, head, join = text, "", "\n"
    elif kind == "md":
        stamp = F.substring(clock(F.floor("start_s").cast("double"), "."), 1, 8)
        if link:
            stamp = F.concat(F.lit("["), stamp, F.lit(f"]({link}/"), F.col("video_id").cast("string"), F.lit("?t="), F.floor("start_s").cast("string"), F.lit(")"))
        part, head, join = F.concat(F.lit("- "), stamp, F.lit(" "), said, F.replace(text, F.lit("\n"), F.lit(" "))), "", "\n"
    else:
        raise ValueError(f"unknown format {kind!r}")
    listed = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("n", part.alias("part")))).alias("p"))
    return listed.select("video_id", F.concat(F.lit(head), F.array_join(F.col("p.part"), join)).alias("content"))


def report_line(summary: DataFrame) -> Column:
    """A row of a report table for each variant."""
    shown = ["recall_1", "recall_5", "recall_10", "mrr", "ndcg"]
    return F.concat(F.lit("| "), F.col("variant"), *[F.concat(F.lit(" | "), F.format_string("%.3f", c)) for c in shown], F.lit(" |"))


def report(summary: DataFrame, by_question: DataFrame, path: str) -> DataFrame:
    """Writes the report of a run under ``path``: a row a variant and a row a question and variant, as JSON
    lines, and gives the table's lines."""
    summary.write.mode("overwrite").json(f"{path}/variants")
    by_question.write.mode("overwrite").json(f"{path}/questions")
    return summary.select("variant", report_line(summary).alias("line"))


def to_backfill(videos: DataFrame, segments: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    """Videos that have speech and no chunks; with ``force`` all that have speech."""
    spoken = videos.join(segments.select("video_id"), "video_id", "left_semi")
    return spoken if force else spoken.join(chunks.select("video_id"), "video_id", "left_anti")


def orphans(files: DataFrame, videos: DataFrame) -> DataFrame:
    """Stored folders of no live video, with their bytes: a report, nothing is deleted."""
    owner = F.regexp_extract("path", r"videos/[^/]+/([^/]+)/", 1)
    marked = files.select(owner.alias("video_key"), "length").where("video_key <> ''")
    lost = marked.join(videos.select(F.col("video_id").cast("string").alias("video_key")), "video_key", "left_anti")
    return lost.groupBy("video_key").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
