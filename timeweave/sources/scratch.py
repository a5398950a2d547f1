"""Tables that jobs write to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="timeweave-")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def with_folder(spark: SparkSession, name: str, act: Callable) -> None:
    """``act`` of a path's file system and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    act(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)


def exists(spark: SparkSession, name: str) -> bool:
    found: list[bool] = []
    with_folder(spark, name, lambda files, path: found.append(files.exists(path)))
    return found[0]


#: Whether a query's shuffle files go when it is over, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Store:
    """Tables that a job writes to the shared folder to cut lineage, and drops when done. What is still
    there when the driver's JVM ends goes then. With ``small`` they take less room, and the queries that
    write them leave no shuffle files."""

    def __init__(self, spark: SparkSession, what: str, small: bool = False):
        self.spark, self.root, self.names, self.small = spark, shared_folder(spark, what), set(), small

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        if self.small:
            with tidy(self.spark):
                df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        else:
            df.write.parquet(f"{self.root}/{name}")
        return self.known(name, df)

    def known(self, name: str, like: DataFrame) -> DataFrame:
        """A table that is in the folder now."""
        if not self.names:
            with_folder(self.spark, self.root, lambda files, path: files.deleteOnExit(path))
        self.names.add(name)
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def only(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*self.names - set(names))

    def drop(self, *names: str) -> None:
        for name in names:
            self.names.discard(name)
            with_folder(self.spark, f"{self.root}/{name}", lambda files, path: files.delete(path, True))

    def close(self) -> None:
        """Drops everything, when the caller has read what it wanted."""
        with_folder(self.spark, self.root, lambda files, path: files.delete(path, True))
        self.names.clear()
