"""License scan by diagonal voting, with column functions alone.

Every rolling k-gram of words of every document is hashed and joined to the k-grams of the
templates. A hit of document place p and template place t lies on the diagonal p - t; hits that
belong to one copy of a template share it, and words put in or left out move the rest of the copy
to a neighbouring diagonal. Hits are verified word by word where they join (so that no hash
collision counts), gathered by diagonal as the set of template places seen, and neighbouring
diagonals merged. The merged span is then verified both ways: the share of the template's words that
the span has, and the share of the span's words that the template has at their places. The lesser of
the two is the copy's score.

Templates are of two kinds. Base phrases count wherever all their words stand consecutively (all
places on one diagonal). Texts, short notices and whole license texts of any length, give their label
where the span's score is at least ``least``. The table of k-grams is bounded by the templates and is
broadcast.

The words array stays in the row that the generator reads, in one code-generated stage with the
join, so only verified hits and one row a document ever leave it: text is not shuffled.

Defined results: null or empty text has no words, null places, empty labels and score 0. Rows with
the same id and text get the same result, one row each; a null id is an id of its own. A
document's hits are aggregated before they are shuffled. Columns but id and text are not read, and
may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Template texts of this operator, by label.
TEXTS = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("this file is released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-text"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
        "mit-whole-text",
    ),
]
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE_K, TEXT_K = 2, 3


def template_grams(spark: SparkSession, base: list[tuple[str, str]], texts: list[tuple[str, str]]) -> DataFrame:
    """``k, gram, place, template, n, label, is_base``: a row for each k-gram of each template."""
    rows = []
    for number, (words, label, is_base) in enumerate([*((p.split(), x, True) for p, x in base), *((t.split(), x, False) for t, x in texts)]):
        k = BASE_K if is_base else TEXT_K
        if len(words) < k:
            raise ValueError(f"a template has {k} words or more: {' '.join(words)}")
        rows += [(k, words[i : i + k], i, number, len(words), label, is_base) for i in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "k int, gram array<string>, place int, template int, n int, label string, is_base boolean")


def _words(places, k) -> F.Column:
    """The template places of all words of the k-grams at ``places``."""
    return F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + k - 1))))


def _hash(k: int, words: list) -> F.Column:
    return F.xxhash64(F.lit(k), *words)


def scan(docs: DataFrame, base=BASE, texts=TEXTS, least: float = 0.9, gap: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score``."""
    spark = docs.sparkSession
    grams = template_grams(spark, base, texts)
    keyed = grams.withColumn("hash", F.when(F.col("k") == BASE_K, _hash(BASE_K, [F.col("gram")[i] for i in range(BASE_K)])).otherwise(_hash(TEXT_K, [F.get("gram", F.lit(i)) for i in range(TEXT_K)])))
    end = spark.createDataFrame([(0, ["end"], 0, -1, 1, None, False)], grams.schema).withColumn("hash", F.xxhash64(F.lit(0)))
    keyed = keyed.unionByName(end)

    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, UPPER, LOWER), SPLIT), "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("of"), F.concat(words, F.array(F.lit(""))).alias("words"))
    # one more element, "", marks the end of the words, so that each document has a row
    placed = rows.select("doc_id", "of", "words", F.posexplode("words").alias("at", "word"))
    word = lambda i: F.get("words", F.col("at") + i)
    hashes = F.array(F.when(F.col("word") == "", _hash(0, [])).otherwise(_hash(BASE_K, [word(i) for i in range(BASE_K)])), _hash(TEXT_K, [word(i) for i in range(TEXT_K)]))
    hits = placed.select("doc_id", "of", "words", "at", "word", F.explode(hashes).alias("hash")).join(F.broadcast(keyed), "hash")
    is_end = F.col("k") == 0
    hits = hits.where(F.when(is_end, F.col("word") == "").otherwise(F.slice("words", F.col("at") + 1, F.greatest(F.col("k"), F.lit(1))) == F.col("gram")))
    diagonals = hits.groupBy("doc_id", "of", "template", F.when(is_end, F.lit(0)).otherwise(F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.max(F.when(is_end, F.col("at"))).alias("n_words"), F.sum(is_end.cast("long")).alias("copies"),
        F.max("k").alias("k"), F.max("n").alias("n"), F.max("label").alias("label"), F.max("is_base").alias("is_base"),
    )
    order = Window.partitionBy("doc_id", "of").orderBy("template", "diagonal")
    far = F.coalesce((F.lag("template").over(order) != F.col("template")) | (F.col("diagonal") - F.lag("diagonal").over(order) > gap), F.lit(True))
    full = F.col("is_base") & (F.size("places") == F.col("n") - F.col("k") + 1)
    alone = F.when(F.col("is_base"), F.size(_words(F.col("places"), F.col("k"))) / F.col("n"))
    copies = (
        diagonals.withColumn("far", far.cast("long")).withColumn("alone", alone).withColumn("full", full)
        .withColumn("copy", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("doc_id", "of", "copy")
        .agg(
            F.collect_list(F.struct("diagonal", "places")).alias("parts"), F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.max("k").alias("gram"), F.max("n").alias("n"), F.max("label").alias("label"),
            F.max("is_base").alias("is_base"), F.count_if("full").alias("n_base"), F.min(F.when(F.col("full"), F.col("diagonal"))).alias("first_word"), F.max(F.when(F.col("full"), F.col("diagonal"))).alias("last_word"),
            F.max("alone").alias("base_score"),
        )
    )
    seen = F.size(F.array_distinct(F.flatten(F.transform("parts", lambda x: _words(x["places"], F.col("gram"))))))
    span = F.array_distinct(F.flatten(F.transform("parts", lambda x: F.transform(_words(x["places"], F.col("gram")), lambda w: w + x["diagonal"]))))
    share = F.when(F.col("is_base"), F.col("base_score")).otherwise(F.least(seen / F.col("n"), F.size(span) / (F.array_max(span) - F.array_min(span) + 1)))
    copies = copies.withColumn("share", share)
    share = F.col("share")
    kept = F.when(F.when(F.col("is_base"), F.col("n_base") > 0).otherwise(share >= least), F.col("label"))
    real = F.col("label").isNotNull()
    found = copies.groupBy("doc_id", "of").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum("n_base").cast("long").alias("n_base"), F.min("first_word").cast("long").alias("first_word"), F.max("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_base"), kept))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set(kept)), ",").alias("labels"),
        F.coalesce(F.max(F.when(real, share)), F.lit(0.0)).alias("score"), F.max("copies").alias("rows"),
    )
    return found.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("of", "rows", "row")


def sql(base=BASE, texts=TEXTS, least: float = 0.9, gap: int = 3) -> str:
    """The same result for ``documents`` by SQL, for comparison."""
    listed = [*((i, p, x, BASE_K, "true") for i, (p, x) in enumerate(base)), *((len(base) + i, t, x, TEXT_K, "false") for i, (t, x) in enumerate(texts))]
    values = ", ".join(f"({i}, '{p}', '{x}', {k}, {b})" for i, p, x, k, b in listed)
    return rf"""
WITH templates AS (SELECT template, string_split(p, ' ') AS w, label, k, is_base FROM (VALUES {values}) t(template, p, label, k, is_base)),
grams AS (SELECT template, label, k, is_base, len(w) AS n, unnest(range(len(w) - k + 1)) AS place, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS gram FROM templates),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPLIT}'), lambda x: x <> '') AS w FROM documents),
ks AS (SELECT unnest([{BASE_K}, {TEXT_K}]) AS k),
places AS (SELECT doc_id, k, unnest(range(greatest(len(w) - k + 1, 0))) AS pos, unnest(list_transform(range(greatest(len(w) - k + 1, 0)), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS gram FROM words, ks),
gathered AS (SELECT doc_id, template, label, is_base, n, g.k, pos - place AS diagonal, list(DISTINCT place) AS places FROM places p JOIN grams g ON g.k = p.k AND g.gram = p.gram GROUP BY ALL),
diagonals AS (SELECT *, list_distinct(flatten(list_transform(places, lambda p: range(p, p + k)))) AS covered FROM gathered),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {gap} THEN 0 ELSE 1 END AS far FROM diagonals),
numbered AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS copy FROM marked),
copies AS (
  SELECT doc_id, template, label, is_base, n, copy, list_distinct(flatten(list(covered))) AS seen, list_distinct(flatten(list(list_transform(covered, lambda w: w + diagonal)))) AS span, max(len(covered)) / n::DOUBLE AS one,
    count(*) FILTER (WHERE is_base AND len(places) = n - k + 1) AS n_base, min(diagonal) FILTER (WHERE is_base AND len(places) = n - k + 1) AS first_word, max(diagonal) FILTER (WHERE is_base AND len(places) = n - k + 1) AS last_word
  FROM numbered GROUP BY doc_id, template, label, is_base, n, copy),
verified AS (SELECT *, least(len(seen) / n::DOUBLE, len(span) / (list_max(span) - list_min(span) + 1)::DOUBLE) AS whole FROM copies),
scored AS (SELECT *, CASE WHEN is_base THEN one ELSE whole END AS share, CASE WHEN is_base THEN n_base > 0 ELSE whole >= {least} END AS kept FROM verified),
found AS (
  SELECT doc_id, CAST(sum(n_base) AS BIGINT) AS n_base, CAST(min(first_word) AS BIGINT) AS first_word, CAST(max(last_word) AS BIGINT) AS last_word, max(share) AS score,
    array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE kept AND is_base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE kept))), ',') AS labels FROM scored GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM words w LEFT JOIN found f USING (doc_id)
"""
