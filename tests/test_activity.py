"""User rankings on hand-written logs."""

import datetime as dt

import pytest

from footfall.functions.times import cycle_periods
from footfall.operators import activity
from footfall.params import TaskParams
from footfall.plans.user_activity import run_user_activity, user_activity
from footfall.registry import settings as S
from footfall.sources import star

LOG = "logId bigint, userId bigint, actionTime timestamp_ntz, actionType int, purchaseMoney double"
USERS = "userId bigint, username string, registTime timestamp_ntz"
REGISTERED = dt.datetime(2024, 1, 5, 6, 0, 0)


def log(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LOG)


def at(day, hour=12, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(1, "a", REGISTERED), (2, "b", REGISTERED)], USERS)


def test_first_days_run_to_the_midnight_before_day_seven(spark, users):
    table = log(
        spark,
        (1, at(5, 5, 59, 59), 0, 0.0),
        (1, REGISTERED, 0, 0.0),
        (1, at(11, 23, 59, 59), 0, 0.0),
        (1, at(12, 0, 0, 0), 0, 0.0),
        (1, at(12, 5, 0, 0), 0, 0.0),
    )
    rows = activity.first_days_log(table, users, activity.VISIT, ("2024-01-01", "2024-01-05"))
    assert sorted(r["logId"] for r in rows.collect()) == [1, 2]
    assert activity.first_days_log(table, users, activity.VISIT, ("2024-01-06", "2024-01-09")).count() == 0


def test_visits_ties_and_unknown_users(spark, users):
    table = log(spark, (2, at(5), 0, 0.0), (1, at(5), 0, 0.0), (9, at(5), 0, 0.0), (9, at(6), 0, 0.0))
    top = activity.top_visits(table, users, ("2024-01-01", "2024-01-31"))
    assert [tuple(r) for r in top.collect()] == [(1, "a", 1), (2, "b", 1)]


def test_repeated_user_rows_add_up_like_a_join(spark, users):
    twice = users.unionByName(users.where("userId = 1"))
    table = log(spark, (1, at(5), 0, 0.0), (1, at(6), 0, 0.0))
    top = activity.top_visits(table, twice, ("2024-01-01", "2024-01-31"))
    assert [tuple(r) for r in top.collect()] == [(1, "a", 4)]


def test_spend_is_exact(spark, users):
    table = log(spark, *[(1, at(5), 1, 0.1)] * 30, (2, at(5), 1, 2.345))
    top = activity.top_spend(table, users, ("2024-01-01", "2024-01-31"))
    assert [tuple(r) for r in top.collect()] == [(1, "a", 3.0), (2, "b", 2.35)]


def test_growth_is_signed(spark, users):
    table = log(
        spark,
        (1, at(20), 0, 0.0),
        (1, at(2), 0, 0.0),
        (1, at(3), 0, 0.0),
        (2, at(20), 0, 0.0),
        (2, at(20), 1, 5.5),
        (2, at(2), 1, 7.0),
    )
    current, previous = ("2024-01-16", "2024-01-31"), ("2024-01-01", "2024-01-15")
    visits = activity.visit_growth(table, users, current, previous)
    assert [tuple(r) for r in visits.collect()] == [(2, "b", 1), (1, "a", -1)]
    spend = activity.spend_growth(table, users, current, previous)
    assert [tuple(r) for r in spend.collect()] == [(2, "b", -1.5)]


def test_one_scan_growth_equals_union_of_periods(spark, sf_dir):
    table, base = star.user_action_log(spark, sf_dir), star.user_base_info(spark, sf_dir)
    # Overlapping periods: a row may count up and down.
    current, previous = ("2024-01-10", "2024-01-30"), ("2024-01-01", "2024-01-15")
    union = activity.signed_periods(table, activity.VISIT, current, previous).groupBy("userId").sum("actionValue")
    expected = sorted(((r[1], -r[0]) for r in union.collect()), reverse=True)[:10]
    growth = activity.visit_growth(table, base, current, previous).collect()
    assert [(r["actionIncr"], -r["userId"]) for r in growth] == expected


@pytest.mark.parametrize(
    "cycle, current, previous",
    [
        ("year", "2024-01-01 00:00:00", ("2023-01-01", "2023-12-31")),
        ("month", "2024-03-01 00:00:00", ("2024-02-01", "2024-02-29")),
        ("week", "2024-03-11 00:00:00", ("2024-03-04", "2024-03-10")),
        ("day", "2024-03-17 00:00:00", ("2024-03-16", "2024-03-16")),
    ],
)
def test_cycle_periods(cycle, current, previous):
    as_of = dt.datetime(2024, 3, 17, 8, 30)  # a Sunday
    assert cycle_periods(as_of, cycle) == ((current, "2024-03-17 08:30:00"), previous)
    with pytest.raises(ValueError):
        cycle_periods(as_of, "decade")


def test_whole_activity_analysis(spark, sf_dir, tmp_path):
    table, base = star.user_action_log(spark, sf_dir), star.user_base_info(spark, sf_dir)
    params = TaskParams(start_date=S.START, end_date=S.END, cycle="week")
    as_of = dt.datetime(2024, 1, 28, 12)
    for _ in range(2):
        run_user_activity(table, base, params, 5, str(tmp_path), as_of=as_of)
    for name, ranking in user_activity(table, base, params, as_of).items():
        written = spark.read.parquet(str(tmp_path / name)).drop("task_id")
        assert sorted(written.collect()) == sorted(ranking.collect())
