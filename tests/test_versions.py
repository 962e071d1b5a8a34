"""Versions of tables: what a reader sees while they are written, and how often rows are written again."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.sinks import folders
from footfall.sinks.changelog import BatchLog, ChangeLog
from footfall.sinks.manifests import Manifests, Run

SCHEMA = "date DATE, k BIGINT, n BIGINT"


def _rows(spark, *values):
    return spark.createDataFrame([(dt.date(2024, 1, d), k, n) for d, k, n in values], SCHEMA).coalesce(1)


def _log(tmp_path, **how):
    return ChangeLog(str(tmp_path / "counts"), ["date", "k"], "n", SCHEMA, **how)


def _totals(df):
    return sorted((r["date"].day, r["k"], r["n"]) for r in df.collect())


def _fail(value):
    return F.when(value >= 0, F.raise_error(F.lit("the task dies"))).otherwise(value)


def test_a_reader_sees_the_state_before_or_after_a_write(spark, tmp_path):
    log = _log(tmp_path, fold_every=2)
    log.write_batch(_rows(spark, (1, 1, 5)), 0)
    opened = log.totals(spark)  # before the next write, read after it
    log.write_batch(_rows(spark, (1, 1, 7), (2, 1, 1)), 1)
    assert _totals(opened) == [(1, 1, 5)]
    during = []
    put = folders.write_text

    def look(session, path, text):  # all files of the batch are there, the version is not
        during.append(_totals(log.totals(spark)))
        put(session, path, text)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("footfall.sinks.manifests.write_text", look)
        log.fold(spark, 2)
        log.write_batch(_rows(spark, (2, 1, 10)), 2)
    assert during == [[(1, 1, 12), (2, 1, 1)]] * 2
    assert _totals(log.totals(spark)) == [(1, 1, 12), (2, 1, 11)]
    assert _totals(opened) == [(1, 1, 5)]
    assert _totals(log.totals(spark, upto=0)) == [(1, 1, 5)]


def test_a_write_that_fails_leaves_the_table_and_is_swept(spark, tmp_path):
    log = _log(tmp_path, fold_every=2)
    log.write_batch(_rows(spark, (1, 1, 5)), 0)
    with pytest.raises(Exception, match="the task dies"):
        log.write_batch(_rows(spark, (1, 1, 7)).withColumn("n", _fail(F.col("n"))), 1)
    assert _totals(log.totals(spark)) == [(1, 1, 5)]
    assert len(os.listdir(f"{log.path}/data")) == 2
    log.write_batch(_rows(spark, (1, 1, 7)), 1)
    log.fold(spark, 2)
    assert _totals(log.totals(spark)) == [(1, 1, 12)]
    assert len(os.listdir(f"{log.path}/data")) == 3  # two batches and what they were folded into


def test_a_lost_folder_is_an_error(spark, tmp_path):
    log = _log(tmp_path)
    for batch_id in range(2):
        log.write_batch(_rows(spark, (1, 1, 1)), batch_id)
    folders.remove(spark, log.folders(spark)[0])
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        log.totals(spark).collect()


def test_versions_that_are_gone_are_an_error(spark, tmp_path):
    log = BatchLog(str(tmp_path / "users"), "k BIGINT", DataFrame.distinct, keep=3)
    for batch_id in range(6):
        log.fold(spark, batch_id)
        log.write_batch(spark.createDataFrame([(batch_id,)], "k BIGINT").coalesce(1), batch_id)
    assert sorted(r.k for r in log.rows(spark, upto=3).collect()) == [0, 1, 2, 3]
    with pytest.raises(LookupError):
        log.rows(spark, upto=1)
    assert log.rows(spark, upto=-1).count() == 0


@pytest.mark.parametrize("batch_id", [3, 4, 5])
def test_repeating_a_batch_again_and_again(spark, tmp_path, batch_id):
    log = BatchLog(str(tmp_path / "users"), "k BIGINT", lambda rows: rows, fold_every=2, keep=2)
    for turn in [*range(batch_id + 1), batch_id, batch_id, batch_id]:
        log.fold(spark, turn)
        log.write_batch(spark.createDataFrame([(turn,)], "k BIGINT").coalesce(1), turn)
    assert sorted(r.k for r in log.all(spark).collect()) == list(range(batch_id + 1))


def test_two_writers_of_one_version_do_not_both_win(spark, tmp_path):
    versions = Manifests(str(tmp_path / "t"))
    versions.commit(spark, 0, [Run("data/a", None, 0, 0, 0)])
    with pytest.raises(FileExistsError):
        folders.write_text(spark, f"{versions.path}/versions/0000000001-0.json", "[]")
    assert versions.newest(spark).runs == [Run("data/a", None, 0, 0, 0)]
    assert not [n for n in folders.children(spark, f"{versions.path}/versions") if n.startswith(".")]


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_bytes_written_grow_as_n_log_n_and_old_days_rest(spark, tmp_path, monkeypatch):
    """200 batches, twenty a day: each day's rows are written once a level, and not at all once the day is over."""
    log = _log(tmp_path, fold_every=4)
    written, files, write = [0], {}, log._write

    def counted(rows, level, first, last):
        runs = write(rows, level, first, last)
        for run in runs:
            written[0] += _bytes(f"{log.path}/{run.folder}")
            files.setdefault(run.day, []).append(last)
        return runs

    monkeypatch.setattr(log, "_write", counted)
    one = spark.range(0, 400, numPartitions=1)
    marks = {}
    for batch_id in range(200):
        day = dt.date(2024, 1, 1 + batch_id // 20)
        rows = one.select(F.lit(day).alias("date"), (F.col("id") + 400 * batch_id).alias("k"), F.lit(1).cast("long").alias("n"))
        log.fold(spark, batch_id)
        log.write_batch(rows, batch_id)
        if batch_id + 1 in (50, 100, 200):
            marks[batch_id + 1] = written[0]
    assert log.totals(spark).count() == 200 * 400
    # A row is written once as a batch, and then once a level: twenty batches a day make two levels.
    plain = marks[50] / 50
    assert marks[200] <= 200 * plain * math.log(200) / math.log(50)
    assert marks[200] <= 2.2 * marks[100] <= 2.2 * 2.2 * marks[50]
    for day, lasts in files.items():
        of_day = range(20 * (int(day[-2:]) - 1), 20 * int(day[-2:]))
        assert set(lasts) <= set(of_day)
    assert len(log.folders(spark)) <= 10 * 2 * 3
