"""The action table stored by day and in buckets of ``session_id``: joins on sessions need no exchange of actions.

A bucket is read by one task. So sessions that hold a large share of all actions are kept out of the buckets, in a plain table
beside them, where they are joined as any others.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.skew import hot_keys

BUCKETS = 64
HOT_SHARE = 0.01


class StoredActions(NamedTuple):
    """Actions in buckets, and those of hot sessions beside them. A session may have actions in both."""

    bucketed: DataFrame
    hot: DataFrame

    def all(self) -> DataFrame:
        return self.bucketed.unionByName(self.hot)

    def each(self, question: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Ask a question that looks at every action by itself, such as whether its session is wanted, of both parts.

        Asked of :meth:`all`, the union would lose the buckets.
        """
        return question(self.bucketed).unionByName(question(self.hot))


def _hot_table(table: str) -> str:
    return f"{table}_hot"


def _split(actions: DataFrame, hot_share: float) -> tuple[DataFrame, DataFrame]:
    session = F.col("session_id")
    hot = session.isin(hot_keys(actions, "session_id", hot_share))
    return actions.where(session.isNull() | ~hot), actions.where(hot)


def _dealt(actions: DataFrame, buckets: int) -> DataFrame:
    """Rows as the buckets are, so that a day has one file a bucket however many tasks write it."""
    return actions.repartition(buckets, "session_id").sortWithinPartitions("date", "session_id", "action_time")


def store_actions(
    actions: DataFrame, table: str, path: str, *, buckets: int = BUCKETS, hot_share: float = HOT_SHARE
) -> StoredActions:
    """Write actions as catalog table ``table`` at ``path``, a folder a day and ``buckets`` files in it, and read them back.

    Sessions with at least ``hot_share`` of all actions, by a sketch, go to the table ``<table>_hot``.
    """
    cold, hot = _split(actions, hot_share)
    writer = _dealt(cold, buckets).write.format("parquet").partitionBy("date").option("path", f"{path}/bucketed")
    writer.bucketBy(buckets, "session_id").sortBy("session_id").saveAsTable(table)
    hot.write.format("parquet").partitionBy("date").option("path", f"{path}/hot").saveAsTable(_hot_table(table))
    return read_actions(actions.sparkSession, table, actions.columns)


def add_days(actions: DataFrame, table: str, *, hot_share: float = HOT_SHARE) -> None:
    """Append actions of further days to stored ones, bucketed as those are."""
    spark = actions.sparkSession
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    cold, hot = _split(actions, hot_share)
    _dealt(cold, int(described["Num Buckets"])).select(*spark.table(table).columns).write.insertInto(table)
    hot.select(*spark.table(_hot_table(table)).columns).write.insertInto(_hot_table(table))


def read_actions(spark: SparkSession, table: str, columns: list[str] | None = None) -> StoredActions:
    parts = [spark.table(name) for name in (table, _hot_table(table))]
    return StoredActions(*(p if columns is None else p.select(*columns) for p in parts))
