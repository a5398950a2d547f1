"""Quality by importance resampling: how much likelier a text is as a target text than as a raw one.

Two generative models are counted over hashed n-grams: bytes by fours, and for each word whether it
repeats the one before it. The raw model counts every document of the corpus, the target model
those that are labelled good. A document's score is the mean log ratio of the two models over its
n-grams. Tempered to the weight of ``strength`` n-grams it is the log importance weight, and adding
Gumbel noise and taking the k greatest samples k documents without replacement in proportion to
their weights. k is the number or share that the caller states; without one, the number of documents whose score is above a
cut. A third of the good labelled
documents, which the target model does not count, sets it: at most ``loss`` of them lie less than
``margin`` above it. At the default strength noise
decides only near the cut; at lower ones rows far from it are sampled in proportion to their weights.

The target model cannot tell good prose that holds toxic words. ``timeweave.llm.toxicity`` learns
these from labels; documents above its cut are set aside before k is counted and are never selected.

The noise is a hash of seed, id and text, so that a task that runs again draws the same. Texts are
read twice: once for all counts, n-grams of every document and words of labelled ones, summed within
tasks and then by feature, and once for all scores. Only the models (``BUCKETS`` numbers,
``max_features`` weights of words) and the labelled sample (at most ``max_labelled`` rows, those of
least hash) come to the driver and go to tasks.
The k-th greatest key is found by narrowing a histogram, without a sort or a collected list.

Defined results: null or empty text has no n-grams, score 0 and is kept when the cut is below 0 (it
is, where good texts are labelled). Without good labels every score is 0 and every document is
selected. Of repeated labels the worst counts; null labels are ignored. Rows with the same id and
text have the same key; rows that tie with the k-th key are all selected. Columns besides id and
text are not read, may have any names, and come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.llm import toxicity
from timeweave.llm.common import Store, by_batch

BUCKETS = 1 << 16  # of byte n-grams; two more count words that repeat and words that do not
STEP = 1 << 22


def features(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams, in steps of bounded size."""
    data = text.encode("utf-8", "surrogatepass")
    for at in range(0, len(data), STEP):
        b = np.frombuffer(data[max(0, at - 3) : at + STEP], np.uint8).astype(np.uint32)
        if len(b) >= 4:
            h = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
            yield (h * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.intp)
    words = data.split()
    if words:
        again = sum(map(eq, words, words[1:]))
        yield np.repeat(np.array([BUCKETS, BUCKETS + 1], np.intp), [again, len(words) - again])


def labelled(labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of good, of other and of toxic labelled documents, ``most`` rows at most."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    good = {r["doc_id"] for r in rows if r["quality"] == 1 and not r["toxic"]}
    others, toxic = ([r["doc_id"] for r in rows if r["doc_id"] not in good], [r["doc_id"] for r in rows if r["toxic"]])
    return tuple(np.array(sorted(ids), np.int64) for ids in (good, others, toxic))


#: What the counting pass gives, by kind: n-grams of (raw, target) texts, word features of (toxic, other)
#: labelled texts, and labelled texts themselves.
GRAM, WORD, TEXT = 0, 1, 2


class Labelled:
    """Ids of good, of other and of toxic labelled documents; some good ones are not shown to the target
    model but held out, to set the cut."""

    def __init__(self, good: np.ndarray, others: np.ndarray, toxic: np.ndarray):
        held = good[good.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32) <= np.uint64((1 << 32) // 3)]
        self.shown = np.setdiff1d(good, held) if 0 < len(held) < len(good) else good
        self.held = held if len(held) else good
        self.good, self.toxic, self.known = good, toxic, np.union1d(good, others)


def counts(docs: DataFrame, own: Labelled) -> DataFrame:
    """``kind, feature, a, b`` over (doc_id, text): all that both models count, in one pass over texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, texts, words = np.zeros((2, BUCKETS + 2), np.int64), np.zeros((1, 2), np.int64), toxicity.Counts()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else np.array([i for i in batch.column(0).to_pylist()], object)
            target, known, toxic = (_among(ids, found) for found in (own.shown, own.known, own.toxic))
            for n, text in enumerate(batch.column(1)):
                text = text.as_py()
                _count_grams(grams, text, bool(target[n]))
                if known[n]:
                    texts[0, 0 if toxic[n] else 1] += 1
                    words.add(text, bool(toxic[n]))
                    if words.full():
                        yield _kinds(WORD, *words.take())
        seen = np.flatnonzero(grams[0])
        yield _kinds(GRAM, seen, grams[:, seen].T)
        yield _kinds(TEXT, np.zeros(1, np.int64), texts)
        yield _kinds(WORD, *words.take())

    rows = docs.mapInArrow(run, "kind int, feature long, a long, b long")
    return rows.groupBy("kind", "feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _among(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ids are among sorted known ones; null ids are not."""
    if ids.dtype == object:
        whole = np.array([i is not None for i in ids], bool)
        found = np.zeros(len(ids), bool)
        found[whole] = _among(ids[whole].astype(np.int64), known)
        return found
    at = np.searchsorted(known, ids)
    return known[np.minimum(at, len(known) - 1)] == ids if len(known) else np.zeros(len(ids), bool)


def _count_grams(into: np.ndarray, text: str, target: bool) -> None:
    for found in features(text):
        many = np.bincount(found, minlength=BUCKETS + 2) if len(found) > BUCKETS else None
        for which in (0, 1)[: 1 + target]:
            if many is None:
                np.add.at(into[which], found, 1)
            else:
                into[which] += many


def _kinds(kind: int, found: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(found), kind, np.int32)), pa.array(found, pa.int64()), pa.array(table[:, 0].copy(), pa.int64()), pa.array(table[:, 1].copy(), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "feature", "a", "b"])


def log_ratios(counted: DataFrame) -> np.ndarray:
    """The log ratio of the models for each bucket; all 0 without good documents."""
    found = counted.where(F.col("kind") == GRAM).toPandas()  # BUCKETS + 2 rows
    table, ratio = np.zeros((2, BUCKETS + 2)), np.zeros(BUCKETS + 2)
    table[0, found["feature"]], table[1, found["feature"]] = found["a"], found["b"]
    if table[1].any():
        for part in (slice(0, BUCKETS), slice(BUCKETS, BUCKETS + 2)):
            raw, target = table[0, part] + 1, table[1, part] + 1
            ratio[part] = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return ratio


def scores(docs: DataFrame, good: np.ndarray, ratio: np.ndarray, evidence: toxicity.Evidence) -> DataFrame:
    """``doc_id, hash, n_grams, score, toxicity, left_out`` over (doc_id, hash, text); ``left_out`` is the
    toxicity of a good labelled text as if it had not been counted."""
    sent = docs.sparkSession.sparkContext.broadcast((good, ratio, evidence))
    names = ["doc_id", "hash", "n_grams", "score", "toxicity", "left_out"]
    schema = pa.schema([*[(n, pa.int64()) for n in names[:3]], *[(n, pa.float64()) for n in names[3:]]])

    def columns(batch: pa.RecordBatch) -> list:
        own, table, marks = sent.value
        sizes, means, toxic, left = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            text, n, total = text.as_py(), 0, 0.0
            for found in features(text):
                n += len(found)
                total += float(table[found].sum())
            sizes.append(n)
            means.append(total / n if n else 0.0)
            toxic.append(marks.toxicity(text))
            at = np.searchsorted(own, doc_id) if doc_id is not None else len(own)
            left.append(marks.toxicity(text, left_out=True) if at < len(own) and own[at] == doc_id else None)
        return [batch.column(0), batch.column(1), sizes, means, toxic, left]

    return docs.mapInArrow(by_batch(columns, schema), "doc_id long, hash long, n_grams long, score double, toxicity double, left_out double")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))


class Model:
    """A fitted model with its scored rows, ``doc_id, hash, n_grams, score, toxicity, key``, and the key
    from which on rows are selected."""

    def __init__(self, docs: DataFrame, labels: DataFrame, k: float | None, loss: float, margin: float, strength: float, seed: int, max_labelled: int, max_features: int, toxic_loss: float, id_col: str, text_col: str):
        spark, texts = docs.sparkSession, _texts(docs, id_col, text_col)
        own, self.store = Labelled(*labelled(labels, max_labelled)), Store(spark, "quality")
        counted = self.store.keep(counts(texts.select("doc_id", "text"), own).where((F.col("kind") != WORD) | (F.col("a") >= 2)), "counts")
        n = counted.where(F.col("kind") == TEXT).first()
        words = counted.where(F.col("kind") == WORD).select("feature", F.col("a").alias("toxic"), F.col("b").alias("other"))
        evidence = toxicity.fit(words, n["a"] if n else 0, n["b"] if n else 0, max_features)
        key = F.col("score") * strength + gumbel(F.lit(seed), F.col("doc_id"), F.col("hash"))
        self.rows = self.store.keep(scores(texts, own.good, log_ratios(counted), evidence).withColumn("key", key), "scores")
        self.store.drop("counts")
        known = spark.createDataFrame([(int(i),) for i in own.held], "doc_id long")  # max_labelled rows at most
        least = self.rows.select("doc_id", "score").join(F.broadcast(known), "doc_id").select(F.expr(f"percentile(score, array({float(loss)}))").alias("cut")).first()["cut"]
        self.cut = min(least[0], 0.0) - margin if least else -float("inf")
        self.toxic_cut = self._toxic_cut(toxic_loss)
        clean = self.rows.select("score", "key", "toxicity").where(F.col("toxicity") <= self.toxic_cut)
        self.selected = clean.where(F.col("score") >= self.cut).count() if k is None else round(k * self.rows.count()) if k < 1 else int(k)
        self.least_key = kth_greatest(clean, "key", self.selected)

    def _toxic_cut(self, loss: float) -> float:
        """What at most ``loss`` of the good labelled texts, each left out of the counts, lie above."""
        left = self.rows.where("left_out is not null")
        n = left.count()
        return kth_greatest(left, "left_out", n - ceil((n - 1) * (1 - loss))) if n else float("inf")

    def is_selected(self) -> Column:
        return (F.col("key") >= self.least_key) & (F.col("toxicity") <= self.toxic_cut)


def gumbel(*of: Column) -> Column:
    """Standard Gumbel noise, a function of ``of``."""
    u = (F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_greatest(rows: DataFrame, key: str, k: int, bins: int = 4096) -> float:
    """The k-th greatest of a finite double column: a histogram whose bins are narrowed around it."""
    ends = rows.agg(F.min(key), F.max(key)).first()
    if k <= 0 or ends[0] is None:
        return float("inf")
    low, high, above = ends[0], ends[1], 0
    for _ in range(12):
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(bins - 1))
        inside = rows.where(F.col(key).between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for r in sorted(inside.collect(), key=lambda r: -r["bin"]):  # one row a bin
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                if above + r["n"] == k:
                    return low
                break
            above += r["n"]
    return low


def classify(docs: DataFrame, labels: DataFrame, k: float | None = None, loss: float = 0.002, margin: float = 0.05, strength: float = 400.0, seed: int = 7, max_labelled: int = 20_000, max_features: int = 200_000, toxic_loss: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The fitted model with its scored rows. ``k`` is how many rows are sampled, or below 1 what share of
    them; without it, as many as lie above the cut."""
    return Model(docs, labels, k, loss, margin, strength, seed, max_labelled, max_features, toxic_loss, id_col, text_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are sampled, with their own columns. Texts are scored once: ids and text
    hashes of sampled rows are joined back to the documents (a key that very many rows share is one of
    rows that repeat, which the adaptive join splits)."""
    model = classify(docs, labels, id_col=id_col, text_col=text_col, **options)
    wanted = model.rows.where(model.is_selected()).select(F.struct("doc_id", "hash").alias("wanted")).distinct()
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    rows = docs.select(key.alias("wanted"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    return rows.join(wanted, "wanted", "left_semi").select("own.*")
