"""Tables fed by micro-batches, on plain Parquet.

A batch is written as a run of its own and becomes part of the table by a new version (see :mod:`.manifests`). Writing the
same batch again starts from the version before it, so nothing counts twice. Runs are folded in levels, each day apart:
``fold_every`` runs of a level become one of the next, so a row is written again once a level, a logarithm of the number of
batches, and a day that gets no rows is never written again. What a reader opens is bounded in the same way.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.sinks.folders import children
from footfall.sinks.manifests import KEEP, Manifests, Run

FOLD_EVERY = 8
# More days than this in one micro-batch are not named one by one: all days are read.
MAX_DAYS = 400


class BatchLog:
    """Rows by micro-batch. ``combine`` turns the rows of many batches into fewer that mean the same.

    Batches come in rising order; writing an earlier one again takes back those after it. ``keep`` is the number of newest
    batches whose versions stay readable.
    """

    def __init__(
        self,
        path: str,
        schema: str,
        combine: Callable[[DataFrame], DataFrame],
        day: str | None = None,
        fold_every: int = FOLD_EVERY,
        keep: int = KEEP,
    ) -> None:
        self.path = path
        self.schema = T.StructType.fromDDL(schema)
        self.combine = combine
        self.day = day
        self.fold_every = max(2, fold_every)
        self.versions = Manifests(path, keep)

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> list[Run]:
        """Write rows into a folder of their own; a run for each day in it."""
        folder = f"data/run={uuid.uuid4().hex}"
        writer = rows.select(*self.schema.fieldNames()).write.mode("errorifexists")
        (writer.partitionBy(self.day) if self.day else writer).parquet(f"{self.path}/{folder}")
        if not self.day:
            return [Run(folder, None, level, first, last)]
        days = [n for n in children(rows.sparkSession, f"{self.path}/{folder}") if n.startswith(f"{self.day}=")]
        return [Run(f"{folder}/{n}", n.removeprefix(f"{self.day}="), level, first, last) for n in sorted(days)]

    def _runs(self, spark: SparkSession, upto: int | None) -> list[Run]:
        version = self.versions.newest(spark, upto)
        return [] if version is None else version.runs

    def _read(self, spark: SparkSession, runs: Sequence[Run]) -> DataFrame:
        if not runs:
            return spark.createDataFrame([], self.schema)
        reader = spark.read.schema(self.schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*(f"{self.path}/{r.folder}" for r in runs)).select(*self.schema.fieldNames())

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        """Idempotent by batch id, provided the source replays the same rows for the same batch."""
        spark = rows.sparkSession
        earlier = self._runs(spark, batch_id - 1)
        self.versions.commit(spark, batch_id, [*earlier, *self._write(rows, 0, batch_id, batch_id)])

    def fold(self, spark: SparkSession, batch_id: int) -> None:
        """To be called before a batch is written. Folds runs of the batches before it where enough have gathered.

        A batch that is repeated starts from the version before it, so its runs may be folded anew and count once.
        """
        runs, level, folded = list(self._runs(spark, batch_id - 1)), 0, False
        while any(r.level >= level for r in runs):
            by_day = defaultdict(list)
            for run in runs:
                if run.level == level:
                    by_day[run.day].append(run)
            due = [r for same in by_day.values() if len(same) >= self.fold_every for r in same]
            if due:
                rows = self.combine(self._read(spark, due))
                rows = rows.hint("rebalance", self.day) if self.day else rows
                first, last = min(r.first for r in due), max(r.last for r in due)
                runs = [r for r in runs if r not in due] + self._write(rows, level + 1, first, last)
                folded = True
            level += 1
        if folded:
            self.versions.commit(spark, batch_id - 1, runs)
            self.versions.sweep(spark)

    def folders(self, spark: SparkSession, upto: int | None = None) -> list[str]:
        """The folders that hold the rows up to a batch."""
        return [f"{self.path}/{r.folder}" for r in self._runs(spark, upto)]

    def rows(
        self, spark: SparkSession, days: Sequence[dt.date] | None = None, upto: int | None = None
    ) -> DataFrame:
        """Rows up to a batch, that one included, as of now. Naming days reads the folders of those days only."""
        runs = self._runs(spark, upto)
        if days is not None and self.day is not None:
            named = {day.isoformat() for day in days}
            runs = [r for r in runs if r.day in named]
        return self._read(spark, runs)

    def of_batch(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self._read(spark, [r for r in self._runs(spark, batch_id) if r.level == 0 and r.first == batch_id])

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self.combine(self.rows(spark, upto=batch_id - 1))

    def all(self, spark: SparkSession) -> DataFrame:
        return self.combine(self.rows(spark))

    def forget_before(self, spark: SparkSession, batch_id: int) -> None:
        """Leave out the batches before one, for rows that nobody reads again."""
        kept = [r for r in self._runs(spark, batch_id) if r.last >= batch_id]
        self.versions.commit(spark, batch_id, kept)


class ChangeLog(BatchLog):
    """Increments of a count by key; the rows of all batches add up."""

    def __init__(
        self, path: str, keys: Sequence[str], value: str, schema: str, day: str = "date", fold_every: int = FOLD_EVERY
    ) -> None:
        self.keys = list(keys)
        self.value = value
        super().__init__(path, schema, self._added, day, fold_every)

    def _added(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.sum(self.value).alias(self.value))

    def totals(
        self, spark: SparkSession, days: Sequence[dt.date] | None = None, upto: int | None = None
    ) -> DataFrame:
        """A hash aggregation with a partial step before the shuffle, over the named days only."""
        return self._added(self.rows(spark, days, upto))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; no rows before anything was written there."""
    try:
        return spark.read.schema(schema).parquet(path).select(*T.StructType.fromDDL(schema).fieldNames())
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def days_in(rows: DataFrame, day: str = "date") -> list[dt.date] | None:
    """The distinct days of a micro-batch, for partition pruning; ``None`` if they are too many to name."""
    found = [r[0] for r in rows.select(day).distinct().limit(MAX_DAYS + 1).collect()]
    return found if len(found) <= MAX_DAYS else None
