"""Writers for result tables."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.sinks.folders import exists, remove, rename

ROWS = "rows"


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


class TaskResults:
    """The result tables of one run of a task, below ``out``: written aside, then put in place together.

    Used as a context. While it is open, the rows of an earlier run stay readable and those of this one are read through what
    :meth:`write` returns. At its end all tables are swapped by renames; if anything fails before or during that, the earlier
    rows are there again and nothing of this run. A result without rows replaces earlier rows as well. A reader who looks
    between the renames can meet tables of two runs, or for a moment none: use :meth:`write` or wait for the end.

    ``written`` counts the rows of each table, observed while they are written.
    """

    def __init__(self, spark: SparkSession, out: str, task_id: int) -> None:
        self.spark = spark
        self.out = out
        self.part = f"task_id={int(task_id)}"
        self.run = uuid.uuid4().hex
        self._observed: dict[str, Observation] = {}

    def _aside(self, table: str, what: str) -> str:
        # Spark's readers pass over names that begin with an underscore.
        return f"{self.out}/{table}/_aside-{self.run}/{what}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        folder, rows = self._aside(table, "new"), Observation()
        self._observed[table] = rows
        df.observe(rows, F.count(F.lit(1)).alias(ROWS)).write.mode("errorifexists").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    @property
    def written(self) -> dict[str, int]:
        return {table: rows_of(observed) for table, observed in self._observed.items()}

    def __enter__(self) -> TaskResults:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        try:
            if kind is None:
                self._swap()
        finally:
            for table in self._observed:
                remove(self.spark, f"{self.out}/{table}/_aside-{self.run}")

    def _swap(self) -> None:
        moved: list[tuple[str, str]] = []
        try:
            for table in self._observed:
                place = f"{self.out}/{table}/{self.part}"
                if exists(self.spark, place):
                    rename(self.spark, place, self._aside(table, "old"))
                    moved.append((self._aside(table, "old"), place))
                rename(self.spark, self._aside(table, "new"), place)
                moved.append((place, self._aside(table, "new")))
        except Exception:
            for source, target in reversed(moved):
                rename(self.spark, source, target)
            raise


def rows_of(observed: Observation) -> int:
    """Rows that went past an observation of a query that has run.

    A part of a plan that turns out to hold no rows may be planned away, and its observation with it: that is no row. Put
    the observation where no later condition can empty the rows before the next shuffle.
    """
    try:
        return observed.get[ROWS]
    except Py4JJavaError:
        return 0


def replace_task(df: DataFrame, task_id: int, path: str) -> DataFrame:
    """Write the rows of one task and read them back; running the task again replaces them.

    The rows are written aside and then swapped in, so a write that fails leaves the earlier ones.
    """
    out, table = path.rsplit("/", 1)
    with TaskResults(df.sparkSession, out, task_id) as results:
        results.write(df, table)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{results.part}")


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all tasks, each with its ``task_id``."""
    return spark.read.schema(T.StructType([*schema.fields]).add("task_id", "bigint")).parquet(path)


def replace_groups(df: DataFrame, path: str, group_by: list[str]) -> None:
    """Replace exactly the groups that occur in ``df``; all other groups stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*group_by).parquet(path)


def append_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    *,
    properties: dict[str, str] | None = None,
    batch_size: int = 1_000,
    max_connections: int = 10,
) -> None:
    """Append to a relation. Each task sends batches over one connection of its own.

    ``max_connections`` protects the database: with more tasks than that Spark narrows the write.
    """
    (
        df.write.format("jdbc")
        .mode("append")
        .options(**(properties or {}))
        .option("url", url)
        .option("dbtable", table)
        .option("batchsize", batch_size)
        .option("numPartitions", max_connections)
        .save()
    )


def preview(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


def first_rows(df: DataFrame, rows: int) -> DataFrame:
    return df.limit(rows)
