"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import local_fallback, materialize, shared_folder
from footfall.sinks.folders import remove

# An Arrow batch is cut at either bound, so a task's memory follows neither the number nor the length of texts.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
}
# Jobs of several steps write each step out; its shuffle files are then of no more use and go at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python tasks get. The settings stay on the session: frames run later."""
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


class Scratch:
    """A fresh folder for the tables of one call, below ``spark.checkpoint.dir``.

    Executors and the driver must see the same files, so a machine-local folder serves ``local[...]`` sessions only.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        spark.conf.set(CLEANUP, "true")
        self.spark = spark
        self.path = shared_folder(spark, purpose, fallback=local_fallback(spark))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write a frame and read it back: lineage ends there, and a lost executor costs nothing."""
        return materialize(df, f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            remove(self.spark, f"{self.path}/{name}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def body(column: str = "text") -> Column:
    """A text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def worker_value(key: object, build: Callable[[], object]) -> object:
    """Build a value once per Python worker, which serves many tasks."""
    if key not in _VALUES:
        _VALUES[key] = build()
    return _VALUES[key]


_VALUES: dict[object, object] = {}
