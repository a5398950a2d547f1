"""Retrieval evaluation over tables of questions and ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions import metrics as m
from timeweave.functions.text import word_count
from timeweave.operators.joins import touches_gold
from timeweave.operators.selection import at_places, percentiles

KS = (1, 5, 10)


def use_of(verified: Column, spans: Column) -> Column:
    return F.when(verified & (F.size(spans) > 0), "scorable").when(verified, "negative").otherwise("unverified")


def sampling_gate(chunks: DataFrame, videos: DataFrame, used: DataFrame, used_key: str, least_s: float = 60.0, least_words: int = 25) -> DataFrame:
    """Chunks fit for a question: of videos long enough, wordy enough and not used yet."""
    long_ = videos.where(F.col("duration_s") > least_s).select("video_id")
    return chunks.join(long_, "video_id", "left_semi").where(word_count(F.col("text")) >= least_words).join(used, used_key, "left_anti")


def even_sample(rows: DataFrame, n: int, key: str = "video_id", order: str = "position") -> DataFrame:
    """n rows of each group at even distances, or all if there are no more."""
    own = Window.partitionBy(key)
    placed = rows.withColumn("_at", F.row_number().over(own.orderBy(order)) - 1).withColumn("_size", F.count("*").over(own))
    step = F.floor((F.col("_at") * n + F.col("_size") - 1) / F.col("_size"))  # the least i with floor(i size / n) >= at
    return placed.where((F.col("_size") <= n) | (F.floor(step * F.col("_size") / n) == F.col("_at"))).drop("_at", "_size")


def relevance(results: DataFrame, questions: DataFrame) -> DataFrame:
    """``variant, question_id, category, relevant, spans_s``: for each question the relevance of its
    results by rank. Questions without results have an empty list."""
    marked = results.join(questions.select("question_id", "gold_spans"), "question_id").withColumn("hit", touches_gold(F.col("gold_spans"), F.col("start_s"), F.col("end_s")))
    ranked = marked.groupBy("variant", "question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "hit", (F.col("end_s") - F.col("start_s")).alias("width")))).alias("r"))
    variants = results.select("variant").distinct()
    every = questions.select("question_id", "category").join(F.broadcast(variants))  # a few variants
    return every.join(ranked, ["variant", "question_id"], "left").select(
        "variant", "question_id", "category", F.coalesce(F.col("r.hit"), F.array().cast("array<boolean>")).alias("relevant"), F.coalesce(F.col("r.width"), F.array().cast("array<double>")).alias("widths")
    )


def per_question(rel: DataFrame) -> DataFrame:
    r = F.col("relevant")
    named = [m.recall(r, k).alias(f"recall_{k}") for k in KS] + [m.precision(r, k).alias(f"precision_{k}") for k in KS]
    return rel.select("variant", "question_id", "category", *named, m.reciprocal_rank(r).alias("mrr"), m.ndcg(r, 10).alias("ndcg"), "widths", m.first_rank(r).alias("first_rank"))


def summarise(scored: DataFrame) -> DataFrame:
    """Macro means of each variant, and the mean width of all results."""
    names = [f"{x}_{k}" for x in ("recall", "precision") for k in KS] + ["mrr", "ndcg"]
    width = F.sum(F.aggregate("widths", F.lit(0.0), lambda a, x: a + x)) / F.nullif(F.sum(F.size("widths")), F.lit(0))
    return scored.groupBy("variant").agg(F.count("*").alias("questions"), *[F.round(F.avg(n), 9).alias(n) for n in names], F.round(F.coalesce(width, F.lit(0.0)), 6).alias("mean_span_s"))


def by_category(scored: DataFrame) -> DataFrame:
    return scored.groupBy("variant", "category").agg(F.round(F.avg("recall_5"), 9).alias("recall_5"))


def refusal(scores: DataFrame, floor: float) -> DataFrame:
    """Of (answerable, score): answers refused, off-corpus questions answered, and the margins."""
    yes, no = F.col("answerable"), ~F.col("answerable")
    # the upper median: of an even number the greater of the two in the middle
    middle = at_places(scores.where(yes), "answerable", "score", {"median_positive": F.floor(F.col("n") / 2)})
    counted = scores.agg(
        F.count_if(yes & (F.col("score") < floor)).alias("false_refusals"), F.count_if(no & (F.col("score") >= floor)).alias("missed_refusals"), F.min(F.when(yes, F.col("score"))).alias("worst_positive"),
        F.max(F.when(no, F.col("score"))).alias("best_negative"),
    )
    return counted.join(F.broadcast(middle.select("median_positive")), F.lit(True), "left")  # one row each


def unsnapped(questions: DataFrame, parents: DataFrame) -> DataFrame:
    """Gold spans that are no parent's bounds, to a tenth of a second."""
    spans = questions.select("question_id", "video_id", F.inline("gold_spans")).select("question_id", "video_id", F.round("s", 1).alias("s"), F.round("e", 1).alias("e"))
    bounds = parents.select("video_id", F.round("start_s", 1).alias("s"), F.round("end_s", 1).alias("e"))
    return spans.join(bounds, ["video_id", "s", "e"], "left_anti")


def start_error(first: DataFrame) -> DataFrame:
    """The median distance of right first results from the anchor, by variant."""
    right = first.where(F.col("anchor_s").isNotNull() & touches_gold(F.col("gold_spans"), F.col("start_s"), F.col("end_s")))
    errors = right.select("variant", F.abs(F.col("start_s") - F.col("anchor_s")).alias("error"))
    return percentiles(errors, "variant", "error", {"error_s": 0.5}).withColumn("error_s", F.round("error_s", 6))


WEIGHTS, DAMPINGS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0), (10.0, 30.0, 60.0, 120.0)


def sweep(lists: DataFrame, chunks: DataFrame, questions: DataFrame, weights=WEIGHTS, dampings=DAMPINGS) -> DataFrame:
    """Scores of each lexical weight and damping: lists are fused and judged as one table of cells."""
    grid = lists.sparkSession.createDataFrame([(w, k) for w in weights for k in dampings], "weight double, damping double")
    own = lambda r: F.min(F.when(F.col("retriever") == r, F.col("rank")))
    ranks = lists.groupBy("query_id", "chunk_id").agg(own("semantic").alias("s"), own("lexical").alias("l"))
    score = F.coalesce(1.0 / (F.col("damping") + F.col("s")), F.lit(0.0)) + F.coalesce(F.col("weight") / (F.col("damping") + F.col("l")), F.lit(0.0))
    order = Window.partitionBy("weight", "damping", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("s"), F.asc_nulls_last("l"), "chunk_id")
    cells = ranks.join(F.broadcast(grid)).withColumn("score", score).withColumn("rank", F.row_number().over(order)).where("rank <= 10")  # a row a cell
    day = 86400.0 * F.col("video_id")
    spans = chunks.select("chunk_id", (F.col("start_s") + day).alias("start_s"), (F.col("end_s") + day).alias("end_s"))
    named = cells.join(spans, "chunk_id").select(F.struct("weight", "damping").alias("variant"), F.col("query_id").alias("question_id"), "rank", "start_s", "end_s")
    scored = per_question(relevance(named, questions))
    shown = ["recall_1", "recall_5", "recall_10", "mrr", "ndcg"]
    return scored.groupBy("variant").agg(*[F.round(F.avg(c), 9).alias(c) for c in shown]).select("variant.*", *shown)
