"""An embedder fitted on the corpus: tf-idf factors by randomized subspace iteration.

Words are hashed to ``FEATURES`` columns; a text is its row of weighted counts, at length 1. The factors
are the directions in which the corpus varies most: a random array of so many columns is multiplied by
the matrix of all texts and its transpose, and made orthogonal, a few times over. Texts are read once:
their counts are stored, and read by each round. Tasks multiply their own rows and add up their products; blocks of features are summed over tasks, so that only an array
of FEATURES times dimensions comes to the driver, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.functions.stemmer import stem
from timeweave.functions.text import ENGLISH_STOP_WORDS
from timeweave.sources.scratch import Store

#: Columns of hashed words, dimensions of a vector, and rounds of the iteration.
FEATURES, DIMENSIONS, ROUNDS = 1 << 14, 64, 3
#: Features that are summed together.
BLOCK = 256
#: Words whose columns a task remembers.
WORDS = 200_000


class Columns(dict):
    """The column of each word, none for stop words; up to ``most`` words are remembered."""

    def __init__(self, most: int = WORDS):
        super().__init__()
        self.most, self.stop = most, frozenset(ENGLISH_STOP_WORDS)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        column = self[word] = -1 if word in self.stop else crc32(stem(word).encode()) % FEATURES
        return column


class Counts:
    """Hashed stems of texts with their counts."""

    def __init__(self):
        self.columns = Columns()

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().split()
        each = np.fromiter(map(self.columns.__getitem__, words), np.intp, len(words))
        found, n = np.unique(each[each >= 0], return_counts=True)
        return found, n.astype(np.float64)


def weighted(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = (1 + np.log(counts)) * idf[found]
    length = np.linalg.norm(weights)
    return weights / length if length else weights


def counted(texts: DataFrame) -> DataFrame:
    """``found, counts``: the columns that each text has, and how often, as arrays of bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts()
        for frame in frames:
            each = [counts.of(text) for text in frame["text"]]
            yield pd.DataFrame({"found": [f.astype(np.uint16).tobytes() for f, _ in each], "counts": [n.astype(np.uint32).tobytes() for _, n in each]})

    return texts.mapInPandas(run, "found binary, counts binary")


def read(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for found, counts in zip(frame["found"], frame["counts"], strict=True):
        yield np.frombuffer(found, np.uint16).astype(np.intp), np.frombuffer(counts, np.uint32).astype(np.float64)


def inverse_frequencies(counts: DataFrame) -> tuple[np.ndarray, int]:
    """How rare each feature is, from the documents that hold it, and how many documents there are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        for frame in frames:
            for found, _ in read(frame):
                seen[found] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"feature": np.r_[at, -1], "n": np.r_[seen[at], n]})

    rows = counts.mapInPandas(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # FEATURES rows
    n = int(rows.loc[rows["feature"] < 0, "n"].sum())
    held = np.zeros(FEATURES)
    known = rows[rows["feature"] >= 0]
    held[known["feature"]] = known["n"]
    return np.log((n + 1) / (held + 1)), n


def multiplied(counts: DataFrame, idf: np.ndarray, into: np.ndarray) -> np.ndarray:
    """The transposed matrix times the matrix times ``into``."""
    sent = counts.sparkSession.sparkContext.broadcast((idf, into))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, into = sent.value
        total = np.zeros_like(into)
        for frame in frames:
            for found, n in read(frame):
                own = weighted(found, n, idf)
                total[found] += own[:, None] * (own @ into[found])
        for at in range(0, FEATURES, BLOCK):
            part = total[at : at + BLOCK]
            if part.any():
                yield pd.DataFrame({"block": [at], "sums": [part.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((BLOCK, into.shape[1]))
        for part in frame["sums"]:
            total += np.frombuffer(part).reshape(BLOCK, -1)
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "sums": [total.tobytes()]})

    rows = counts.mapInPandas(run, "block long, sums binary").groupBy("block").applyInPandas(add, "block long, sums binary").collect()  # FEATURES / BLOCK rows
    out = np.zeros_like(into)
    for r in rows:
        out[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["sums"]).reshape(BLOCK, -1)
    return out


class Factors:
    """An embedder: ``encode`` of a batch of texts, as the model functions take it."""

    def __init__(self, idf: np.ndarray, factors: np.ndarray):
        self.idf, self.factors, self.counts = idf, factors, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}  # a task meets its own words

    def encode(self, texts: list[str]) -> np.ndarray:
        self.counts, out = self.counts or Counts(), np.zeros((len(texts), self.factors.shape[1]), np.float32)
        for row, text in zip(out, texts, strict=True):
            found, n = self.counts.of(text)
            row[:] = weighted(found, n, self.idf) @ self.factors[found]
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.encode(texts)


def fit(rows: DataFrame, text_col: str = "text", dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = 5) -> Callable[[list[str]], np.ndarray]:
    """The embedder of a corpus. Null texts are empty; an empty corpus gives zero vectors."""
    texts = rows.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    store = Store(rows.sparkSession, "counts")
    counts = store.keep(counted(texts), "counts")
    idf, n = inverse_frequencies(counts)
    factors = np.random.default_rng(seed).normal(size=(FEATURES, dimensions))
    for _ in range(rounds if n else 0):
        factors, _ = np.linalg.qr(multiplied(counts, idf, factors))
    store.close()
    return Factors(idf, factors)
