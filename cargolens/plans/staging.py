"""Cutting lineage: write an intermediate table to the shared checkpoint folder and read it back.

A staged table is Parquet, so later passes prune columns and push filters, and a lost executor
costs a re-read instead of a re-computation.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open_paths: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else one in the warehouse; executors share both."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, removed by ``release``."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _open_paths.append(path)
    return path


#: Spark deletes the shuffle files of a query that ends under this setting, instead of keeping them until the driver's heap is collected.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """For writes: what they shuffled is deleted as soon as their output stands, since nobody reads it again."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def stage(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` once and return the reader over it; ``codec`` is that of the session by default."""
    path = stage_path(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark._jsc.hadoopConfiguration()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)
    paths.clear()


def release(spark: SparkSession) -> None:
    """Delete what this process has staged; no DataFrame over it may be used afterwards."""
    _delete(spark, _open_paths)


class Staging:
    """Staged tables of one job, deleted together when the job has written its results."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths: list[str] = []

    def __call__(self, df: DataFrame, name: str = "stage") -> DataFrame:
        path = f"{checkpoint_folder(self._spark)}/{name}-{uuid.uuid4().hex}"
        self._paths.append(path)
        with freed_shuffles(self._spark):
            df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        _delete(self._spark, self._paths)
