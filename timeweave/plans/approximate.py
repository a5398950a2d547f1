"""Approximate nearest chunks from a stored index.

*The index.* Unit vectors are filed under their nearest of k centroids, k in proportion to the square
root of their number. What a centroid leaves of a vector, its residual, is cut in parts, and each part
coded by the nearest of at most 256 codewords: ``code`` has a byte a part, a sixteenth of the vector or
less. Codes and vectors lie in one table with a folder a file, so a search reads the files that it looks
into, of most rows the codes alone.

*A search* looks into the files nearest to each query. The product of a query and a vector is about
that with the centroid plus that with the codewords of the vector's parts. The best ``ranked`` of each query
by these sums are compared with it exactly, in the tasks that read them: a first pass over the codes counts
them in bins of distance, which shows where the best end.

Centroids and codewords are fitted on a bounded sample, those vectors of least hash; every vector is
indexed. ``search.nearest`` is the exact way; tests hold recall and shares of this one against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.functions import vectors as V
from timeweave.plans.best import Best

#: Vectors that centroids and codewords are fitted on at most, and files at most.
FITTED, MOST_FILES = 20_000, 4096
#: Files for each unit of the square root of the rows.
PER_ROOT = 4
#: Numbers that share a byte of a code, and codewords of a part.
PART, CODEWORDS = 4, 256
#: The share of files that a query looks into, and the rows of a query that are compared exactly, at
#: least and as a share of all.
PROBED, RANKED, RANKED_SHARE = 0.5, 100, 0.05
#: Queries that go to the tasks at once; more are searched in further passes.
QUERIES = 4096
#: Bins of distance by which the rows to be compared are found, queries whose counts are added up together, and rows
#: that a task compares at once.
BINS, GROUP, ROWS = 512, 64, 512
#: Hits more than asked for that tasks hand on, as their sums round otherwise than those that order the result.
SLACK = 2


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


def nearest_codeword(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(axis=1) - 2 * rows @ words.T, axis=1)


def codewords(rows: np.ndarray, most: int, rounds: int = 15) -> np.ndarray:
    """Codewords of one part of the sample, by Lloyd's iteration from rows in even steps."""
    words = rows[np.linspace(0, len(rows) - 1, min(most, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest_codeword(rows, words)
        n = np.bincount(near, minlength=len(words))
        sums = np.stack([np.bincount(near, weights=column, minlength=len(words)) for column in rows.T], axis=1)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


class Model:
    """Centroids, and the codewords of each part of a residual."""

    def __init__(self, centres: np.ndarray, words: list[np.ndarray]):
        self.centres, self.words = centres, words
        self.edges = np.cumsum([0] + [w.shape[1] for w in words])

    def parts(self, rows: np.ndarray) -> list[np.ndarray]:
        return [rows[:, a:b] for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The file and the code of unit vectors."""
        file = np.argmax(rows @ self.centres.T, axis=1)
        left = rows - self.centres[file]
        return file, np.stack([nearest_codeword(p, w) for p, w in zip(self.parts(left), self.words, strict=True)], axis=1).astype(np.uint8)

    def products(self, queries: np.ndarray) -> np.ndarray:
        """(query, part, codeword): products with all codewords."""
        tables = np.zeros((len(queries), len(self.words), max(len(w) for w in self.words)), np.float32)
        for n, (own, words) in enumerate(zip(self.parts(queries), self.words, strict=True)):
            tables[:, n, : len(words)] = own @ words.T
        return tables


def fit(chunks: DataFrame, fitted: int = FITTED, most_files: int = MOST_FILES, part: int = PART, seed: int = 1) -> Model:
    """The model of (chunk_id, embedding). Each part's codewords are a task of their own."""
    known = chunks.where("embedding is not null").select("chunk_id", V.unit(F.col("embedding")).alias("u"))
    sample = known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(fitted)
    n = known.count()
    k = max(1, min(most_files, fitted, n, round(PER_ROOT * sqrt(n))))
    centres = _unit(np.array(KMeans(k=k, seed=seed, maxIter=10).fit(sample.select(array_to_vector("u").alias("features"))).clusterCenters()))
    sent = chunks.sparkSession.sparkContext.broadcast(centres)
    width = centres.shape[1]
    starts = list(range(0, width, part))

    def residual_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                rows = np.stack(frame["u"].to_numpy())
                left = rows - sent.value[np.argmax(rows @ sent.value.T, axis=1)]
                for at in starts:
                    yield pd.DataFrame({"part": at, "row": frame["chunk_id"], "x": list(left[:, at : at + part])})

    def words_of(frame: pd.DataFrame) -> pd.DataFrame:
        found = codewords(np.stack(frame.sort_values("row")["x"].to_numpy()), CODEWORDS)
        return pd.DataFrame({"part": frame["part"].iloc[0], "word": np.arange(len(found)), "x": list(found)})

    made = sample.mapInPandas(residual_parts, "part int, row long, x array<double>").groupBy("part").applyInPandas(words_of, "part int, word int, x array<double>").toPandas()  # parts times CODEWORDS
    return Model(centres, [np.stack(own.sort_values("word")["x"].to_numpy()) for _, own in sorted(made.groupby("part"))])


class Index:
    """A stored index: ``rows`` (file, chunk_id, code, embedding), its model, and how many rows a file has."""

    def __init__(self, spark: SparkSession, path: str, model: Model):
        self.spark, self.path, self.model = spark, path, model
        self.rows = spark.read.schema("file int, chunk_id long, code binary, embedding array<float>").parquet(path)


def write_index(chunks: DataFrame, path: str, model: Model | None = None) -> Index:
    """Files every vector of (chunk_id, embedding) under ``path``."""
    model = fit(chunks) if model is None else model
    sent = chunks.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                file, code = sent.value.encode(_unit(np.stack(frame["embedding"].to_numpy()).astype(np.float64)))
                yield pd.DataFrame({"chunk_id": frame["chunk_id"], "code": [c.tobytes() for c in code], "embedding": frame["embedding"], "file": file.astype(np.int32)})

    rows = chunks.where("embedding is not null").select(F.col("chunk_id").cast("long"), F.col("embedding").cast("array<float>"))
    coded = rows.mapInPandas(run, "chunk_id long, code binary, embedding array<float>, file int")
    coded.repartition("file").sortWithinPartitions("file", "chunk_id").write.partitionBy("file").parquet(path)
    return Index(chunks.sparkSession, path, model)


def probed_files(queries: np.ndarray, model: Model, probed: float) -> np.ndarray:
    """For each unit vector whether it looks into each file: the nearest ones."""
    most = max(1, ceil(probed * len(model.centres)))
    near = np.argsort(-(queries @ model.centres.T), axis=1, kind="stable")[:, :most]
    out = np.zeros((len(queries), len(model.centres)), bool)
    np.put_along_axis(out, near, True, axis=1)
    return out


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of a stated query set, in blocks of bounded size."""
    known = queries.where("embedding is not null").select("query_id", "embedding")
    n = max(1, -(-known.count() // block))
    for i in range(n):
        rows = known.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect()
        if rows:
            yield np.array([r["query_id"] for r in rows], np.int64), _unit(np.array([r["embedding"] for r in rows], np.float64))


def decoded(codes: np.ndarray, model: Model) -> np.ndarray:
    """The residuals that codes stand for."""
    return np.concatenate([words[codes[:, n]] for n, words in enumerate(model.words)], axis=1)


def _about(own: pd.DataFrame, file: int, who: np.ndarray, asked: np.ndarray, model: Model) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of one file, some at once, and about how far each is from each of some queries: the product with the
    centroid and with what the code stands for."""
    centred = (asked[who] @ model.centres[file])[:, None]
    for at in range(0, len(own) if len(who) else 0, ROWS):
        part = own.iloc[at : at + ROWS]
        codes = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
        yield part, 1.0 - centred - asked[who] @ decoded(codes, model).T


def _bin(about: np.ndarray) -> np.ndarray:
    """Of distances from 0 to 2, the bin."""
    return np.clip(about * (BINS / 2), 0, BINS - 1).astype(np.int32)


def reaches(read: DataFrame, sent, block: int, ranked: int) -> np.ndarray:
    """The bin of each query that its ``ranked`` best rows by codes end in: tasks count the rows in bins of
    distance, and the counts of some queries at a time are added up, so no rows are sorted or moved."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, asked, files, model = sent.value
        counts = np.zeros((len(asked), BINS), np.int32)
        for frame in frames:
            for file, own in frame.groupby("file"):
                who = np.flatnonzero(files[:, file])
                for _, about in _about(own, file, who, asked, model):
                    place = _bin(about) + (np.arange(len(who)) * BINS)[:, None]
                    counts[who] += np.bincount(place.ravel(), minlength=len(who) * BINS).reshape(len(who), BINS).astype(np.int32)
        for at in range(0, len(counts), GROUP):
            yield pd.DataFrame({"part": [at], "counts": [counts[at : at + GROUP].tobytes()]})

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int32).reshape(-1, BINS).astype(np.int64) for c in frame["counts"])
        end = np.argmax(np.cumsum(total, axis=1) >= np.minimum(ranked, total.sum(axis=1))[:, None], axis=1)
        return pd.DataFrame({"query": frame["part"].iloc[0] + np.arange(len(end)), "end": end})

    rows = read.select("file", "code").mapInPandas(run, "part long, counts binary").groupBy("part").applyInPandas(ends, "query long, end long").collect()  # a row a query of the block
    out = np.full(block, BINS, np.int64)
    for r in rows:
        out[r["query"]] = r["end"]
    return out


def near(index: Index, ids: np.ndarray, asked: np.ndarray, probed: float, ranked: int, limit: int) -> DataFrame:
    """``query_id, file, chunk_id`` of what may be the ``limit`` nearest of each query. Of the rows in the files
    that it looks into the ``ranked`` best by codes, and those of the same bin as the last of these, are compared by
    whole vectors where they are read; each task keeps its best. Files that nobody looks into are not read."""
    files = probed_files(asked, index.model, probed)
    sent = index.spark.sparkContext.broadcast((ids, asked, files, index.model))
    read = index.rows if files.any(axis=0).all() else index.rows.where(F.col("file").isin([int(f) for f in np.flatnonzero(files.any(axis=0))]))
    ends = index.spark.sparkContext.broadcast(reaches(read, sent, len(ids), ranked))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, asked, files, model = sent.value
        best, found_file = Best(len(ids), limit), {}
        for frame in frames:
            for file, own in frame.groupby("file"):
                who = np.flatnonzero(files[:, file])
                for part, about in _about(own, file, who, asked, model):
                    row, column = np.nonzero(_bin(about) <= ends.value[who][:, None])
                    units, exact = _unit(np.stack(part["embedding"].to_numpy()).astype(np.float64)), np.full(about.shape, np.inf)
                    exact[row, column] = 1.0 - np.einsum("ij,ij->i", asked[who[row]], units[column])
                    chunk = part["chunk_id"].to_numpy()
                    found_file.update(zip(chunk.tolist(), [file] * len(chunk), strict=True))
                    best.add(exact, chunk, who)
            kept = set(best.settle().id.tolist())
            found_file = {c: f for c, f in found_file.items() if c in kept}
        yield pd.DataFrame({"query_id": ids[best.query], "file": np.array([found_file[c] for c in best.id.tolist()], np.int32), "chunk_id": best.id, "about": best.distance})

    each = read.select("file", "chunk_id", "code", "embedding").mapInPandas(run, "query_id long, file int, chunk_id long, about double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("about", "chunk_id"))
    return each.withColumn("n", order).where(F.col("n") <= limit).select("query_id", "file", "chunk_id")


def search(queries: DataFrame, index: Index, limit: int, probed: float = PROBED, ranked: int | None = None) -> DataFrame:
    """``query_id, chunk_id, distance, rank``: the nearest of each query's candidates, by whole vectors."""
    ranked = to_rank(index) if ranked is None else ranked
    found = index.spark.createDataFrame([], "query_id long, chunk_id long, distance double")
    asked = queries.where("embedding is not null").select("query_id", V.doubles(F.col("embedding")).alias("q"))
    for ids, units in _blocks(queries, QUERIES):
        whole = near(index, ids, units, probed, ranked, limit + SLACK).join(index.rows.select("file", "chunk_id", "embedding"), ["file", "chunk_id"]).join(asked, "query_id")
        found = found.unionByName(whole.select("query_id", "chunk_id", (1 - V.cosine(F.col("q"), F.col("embedding"))).alias("distance")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def to_rank(index: Index) -> int:
    return max(RANKED, ceil(RANKED_SHARE * index.rows.count()))


def looked_at(queries: DataFrame, index: Index, probed: float = PROBED, ranked: int | None = None) -> DataFrame:
    """``query_id, codes, vectors``: the shares of all rows whose codes, and whose vectors, are read for
    each query."""
    sizes = {r["file"]: r["count"] for r in index.rows.groupBy("file").count().collect()}  # a row a file
    n, ranked = sum(sizes.values()), to_rank(index) if ranked is None else ranked
    many = np.array([sizes.get(f, 0) for f in range(len(index.model.centres))])
    rows = []
    for ids, units in _blocks(queries, QUERIES):
        codes = probed_files(units, index.model, probed) @ many
        rows += [(int(i), float(c) / n, min(float(c), ranked) / n) for i, c in zip(ids, codes, strict=True)]
    return queries.sparkSession.createDataFrame(rows, "query_id long, codes double, vectors double")
