"""Run history, deletions, collections, and the making of question sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.models import complete
from timeweave.functions.text import collapse, strip

# Fixed value: stages whose failure degrades a run and does not fail it.
VISUAL = ["keyframes", "ocr"]


def job_outcome(stages: DataFrame) -> DataFrame:
    """A job fails if a stage other than the visual ones failed; else it is done, maybe in part."""
    failed = F.col("status") == "failed"
    own = stages.groupBy("seq").agg(F.max(failed & ~F.col("name").isin(VISUAL)).alias("fatal"), F.max(failed).alias("any"))
    return own.select("seq", F.when(F.col("fatal"), "failed").when(F.col("any"), "degraded").otherwise("succeeded").alias("outcome"))


def delete_videos(dependents: DataFrame, deleted: DataFrame) -> DataFrame:
    """The rows of a dependent table that stay."""
    return dependents.join(deleted.select("video_id"), "video_id", "left_anti")


def delete_collections(videos: DataFrame, deleted: DataFrame) -> DataFrame:
    """Videos of deleted collections are unfiled."""
    gone = deleted.select("collection_id").distinct().withColumn("_gone", F.lit(True))
    return videos.join(gone, "collection_id", "left").withColumn("collection_id", F.when(F.col("_gone").isNull(), F.col("collection_id"))).drop("_gone")


def file_videos(videos: DataFrame, moves: DataFrame) -> DataFrame:
    """Membership is exclusive: the last move (by seq) of a video sets its collection."""
    last = moves.groupBy("video_id").agg(F.max(F.struct("seq", "collection_id")).alias("m"))
    return videos.join(last, "video_id", "left").withColumn("collection_id", F.when(F.col("m").isNotNull(), F.col("m.collection_id")).otherwise(F.col("collection_id"))).drop("m")


def taken_names(collections: DataFrame) -> DataFrame:
    return collections.groupBy(F.lower(strip(F.col("name"))).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def curate(questions: DataFrame, reviewed: DataFrame, dropped: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Dropped questions go, rewritten ones change, and only reviewed ones count as verified."""
    kept = questions.join(dropped.select("id"), "id", "left_anti")
    new = kept.join(rewritten.select("id", F.col("question").alias("_new")), "id", "left").withColumn("question", F.coalesce("_new", "question")).drop("_new")
    return new.join(reviewed.select("id").distinct().withColumn("_seen", F.lit(True)), "id", "left").withColumn("verified", F.coalesce("_seen", F.lit(False))).drop("_seen")


# What a model's answer looks like, with a fence or cut off, and the word for no question.
FENCE, ARRAY = r"(?s)```(?:json)?\s*(.*?)```", r"(?s)(\[.*\])"
CUT_ITEM = r'\{\s*"n"\s*:\s*(\d+)\s*,\s*"question"\s*:\s*"([^"]*)"'
SKIPPED, SHORTEST = "SKIP", 10


def salvage(raw: Column, size: int) -> Column:
    """(index, question) pairs from a model's answer: the JSON array in it, with or without a fence; of
    one that is cut off or broken every question whose own quotes are closed. Numbers count from one;
    skipped, short and strange ones go."""
    fence = F.regexp_extract(raw, FENCE, 1)
    text = strip(F.when(fence != "", fence).otherwise(raw))
    parsed = F.from_json(F.regexp_extract(text, ARRAY, 1), "array<struct<n:string,question:string>>")
    numbers, said = F.regexp_extract_all(text, F.lit(CUT_ITEM), F.lit(1)), F.regexp_extract_all(text, F.lit(CUT_ITEM), F.lit(2))
    left = F.transform(numbers, lambda n, i: F.struct(n.alias("n"), F.get(said, i).alias("question")))
    usable = F.when(F.coalesce(F.size(parsed), F.lit(0)) > 0, parsed).otherwise(left)
    pairs = F.transform(usable, lambda x: F.struct((x["n"].try_cast("int") - 1).alias("index"), collapse(x["question"]).alias("question")))
    return F.filter(pairs, lambda p: p["index"].between(0, size - 1) & (F.upper(p["question"]) != SKIPPED) & (F.length(p["question"]) > SHORTEST))


def question_candidates(chunks: DataFrame, parents: DataFrame, each: int, batch: int = 8) -> DataFrame:
    """Sampled chunks with their parent's span, in batches for a model."""
    from timeweave.plans.evaluation import even_sample

    picked = even_sample(chunks, each).join(parents.select("video_id", "parent_id", F.col("start_s").alias("gold_s"), F.col("end_s").alias("gold_e")), ["video_id", "parent_id"])
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("position")) - 1
    return picked.withColumn("batch", F.floor(n / batch)).withColumn("n", n % batch + 1)


WRITER = "Write one question for each numbered passage that it alone answers, as a JSON array of objects with n and question; SKIP as a question where there is none."


def build_questions(chunks: DataFrame, parents: DataFrame, each: int, model: Callable[[str, str], str], batch: int = 8) -> DataFrame:
    """The question set of a library: sampled chunks (video_id, position, chunk_id, start_s, text, parent_id)
    go to a model in batches, and what can be read of its answers becomes unverified questions (``id,
    question, category, video_id, gold_spans, kind, source_chunk_id, anchor_s, verified``) with the
    parent's span as gold."""
    picked = question_candidates(chunks, parents, each, batch)
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), collapse(F.col("text")))
    asked = picked.groupBy("video_id", "batch").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    prompts = asked.select(F.struct("video_id", "batch").alias("of"), F.array_join(F.col("l.line"), "\n").alias("prompt"))
    keyed = prompts.select("of", F.xxhash64("of").alias("query_id"), "prompt")
    said = complete(keyed, model, WRITER).join(keyed.select("query_id", "of"), "query_id")
    read = said.select("of.*", F.inline(salvage(F.col("completion"), batch))).withColumn("n", F.col("index") + 1)
    first = read.groupBy("video_id", "batch", "n").agg(F.min("question").alias("question"))
    found = first.join(picked, ["video_id", "batch", "n"])
    return found.select(
        F.format_string("gen-%d-%d", "video_id", "position").alias("id"), "question", F.lit("generated").alias("category"), "video_id", F.array(F.struct(F.col("gold_s").alias("s"), F.col("gold_e").alias("e"))).alias("gold_spans"),
        F.lit("transcript").alias("kind"), F.col("chunk_id").alias("source_chunk_id"), F.col("start_s").alias("anchor_s"), F.lit(False).alias("verified"),
    )


def anchors(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions with ``anchor_s``, the start of the chunk that each was made of; null without one."""
    own = chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.col("start_s").alias("anchor_s"))
    return questions.drop("anchor_s").join(own, "source_chunk_id", "left")
