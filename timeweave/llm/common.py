"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.sources.scratch import Store, shared_folder

__all__ = ["Memo", "STEP_CHARS", "Store", "by_batch", "held", "join_by_hot_key", "shared_folder", "small_batches", "table"]

#: Characters that one vectorised step works on; longer texts carry their state over.
STEP_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_by_hot_key(rows: DataFrame, lookup: DataFrame, key: str, n: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``lookup``, which has each key once and in ``n`` how many rows hold
    it. Keys of more than one row in ``share``, of which there are ``share`` at most, are broadcast; no
    other key is hot. ``n`` is dropped."""
    total = lookup.agg(F.sum(n)).first()[0] or 0
    hot, cold = lookup.where(F.col(n) * share > total).drop(n), lookup.where(F.col(n) * share <= total).drop(n)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows in an Arrow batch, so that batches of long texts and sets stay small; for jobs that
    run within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Keys of a memo that are kept at most so long: what is longer is made anew each time.
LONGEST = 512


class Memo(dict):
    """A bounded memo: when ``most`` new entries are in, those used since the last time stay.

    Entries that were found again move to the young generation, the dictionary itself; ``age()``,
    called between batches, lets the young ones take the place of the old. Long keys, which hardly
    ever come again, are not kept, so the bound on entries is one on bytes: four times ``most``
    entries of ``LONGEST``, and what is made of them.
    """

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        if len(self) >= 2 * self.most:
            self.age()
        return value

    def age(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


_held: dict = {}


def held(key: tuple, make: Callable):
    """What ``make()`` gives, kept by this Python worker until it needs something else.

    Spark uses its workers again for other stages, so a worker keeps the tables of one operator
    alone: those of the last one go before new ones are built.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


#: Rows of an Arrow batch that are worked on, and given out, at once.
SLICE = 500


def by_batch(columns: Callable[[pa.RecordBatch], list], schema: pa.Schema) -> Callable:
    """A function for mapInArrow that turns each few hundred rows into a batch of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                made = zip(columns(batch.slice(at, SLICE)), schema, strict=True)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in made], schema=schema)

    return run
