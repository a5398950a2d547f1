"""A corpus pipeline: quality, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and gives the rows it keeps, with the columns of
``documents`` but for the last, which gives their token ids. ``run`` writes each stage's result as
Parquet in the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm import op6_decontaminate, op8_bpe_codec, op9_quality, op10_jaccard_join
from timeweave.llm.common import Store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects as target-like; the others go.

    Null and empty texts score 0 and stay where the cut is below 0; rows of the same id and text stay
    or go together, as do rows that tie at the cut; null ids are rows like others. Without good labels
    all stay. Columns of ``docs`` may have any names and all come back.
    """
    return op9_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8.

    The least id of a group stays (null before all), then the least text hash; of rows that repeat
    both, one. Null texts, empty ones and those without words are in no group and all stay. A text of
    fewer than five words is one shingle.
    """
    return op10_jaccard_join.keep_one(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage within its error budget.

    Null and empty texts hold none and stay. Repeated rows stay or go together. Null items are no items.
    """
    return op6_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, round_trip``: token ids, and whether they decode to the text.

    One row a document, whatever its id; a null or empty text has no ids and a true round trip. Other
    columns are not read.
    """
    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = op8_bpe_codec.round_trip(docs, vocabulary, pattern)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.col("exact").alias("round_trip"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("tokens", tokens)]

#: The stages hash, sample and tokenize as no SQL does; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs, before = Store(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), name)
        if before:
            store.drop(before)
        before = name
    return docs
