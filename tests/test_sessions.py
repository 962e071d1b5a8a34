"""Roll-up, filters, histogram and sampling on hand-written sessions."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators import histogram, sampling, scans, sessions
from footfall.params import TaskParams
from footfall.sources.tables import typed_actions

DAY = dt.date(2024, 1, 5)
START = dt.datetime(2024, 1, 5, 9, 0, 0)


def action(session, user, seconds=0, page=1, word=None, category=None):
    time = START + dt.timedelta(seconds=seconds)
    return (time.date(), user, session, page, time, word, category, None, None, None, None, None, 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.USER_VISIT_ACTION)


def user(user_id, age=30, professional="it", city="x", sex="male"):
    return (user_id, f"u{user_id}", f"n{user_id}", age, professional, city, sex)


@pytest.fixture
def users(spark):
    rows = [user(1), user(2, age=50, professional="law", city="y", sex="female"), user(3, age=None)]
    return spark.createDataFrame(rows, schemas.USER_INFO)


def test_words_and_categories_are_exact_sets(spark, users):
    actions = frame(
        spark,
        [
            action("s", 1, 0, word="新辣道鱼火锅"),
            action("s", 1, 1, word="火锅"),
            action("s", 1, 2, word="火锅"),
            action("s", 1, 3, word=""),
            action("s", 1, 4, category=11),
            action("s", 1, 5, category=1),
            action("s", 1, 6, category=2),
        ],
    )
    row = sessions.session_rollup(actions, users).head()
    assert row["search_keywords"] == "新辣道鱼火锅,火锅"
    assert row["click_category_ids"] == "1,2,11"
    assert (row["visit_length"], row["step_length"]) == (6, 7)


def test_session_without_words_has_null_lists(spark, users):
    row = sessions.session_rollup(frame(spark, [action("s", 1)]), users).head()
    assert row["search_keywords"] is None and row["click_category_ids"] is None


def test_shared_session_belongs_to_the_first_user(spark, users):
    actions = frame(
        spark,
        [
            action("a", 2, 0),
            action("a", 1, 5),
            action("tie", 2, 0),
            action("tie", 1, 0),
            action("unknown", 99, 0),
        ],
    )
    for table in (
        sessions.session_rollup(actions, users),
        sessions.matching_spans(actions, users, TaskParams()),
    ):
        found = {r["session_id"]: (r["user_id"], r["step_length"]) for r in table.collect()}
        assert found == {"a": (2, 2), "tie": (1, 2)}


FILTERS = [
    TaskParams(),
    TaskParams(start_age=25, end_age=35),
    TaskParams(start_age=60),
    TaskParams(professionals=("law", "art")),
    TaskParams(cities=("x",)),
    TaskParams(sex="female"),
    TaskParams(keywords=("b", "zzz")),
    TaskParams(keywords=("c",)),
    TaskParams(category_ids=(1, 7)),
    TaskParams(keywords=("a",), category_ids=(11,), sex="male"),
]


@pytest.mark.parametrize("params", FILTERS)
def test_lean_and_full_filters_agree(spark, users, params):
    actions = frame(
        spark,
        [
            action("s1", 1, 0, word="a"),
            action("s1", 1, 9, category=11),
            action("s2", 2, 0, word="b"),
            action("s2", 2, 1, category=1),
            action("s3", 3, 0, word="a,c"),
            action("s4", 1, 0),
        ],
    )
    full = sessions.filter_sessions(sessions.session_rollup(actions, users), params)
    lean = sessions.matching_spans(actions, users, params)
    columns = ["session_id", "user_id", "start_time", "visit_length", "step_length", "age", "city"]
    assert sorted(map(str, full.select(columns).collect())) == sorted(map(str, lean.select(columns).collect()))
    if params == TaskParams() or params.end_age is None and params.start_age is not None:
        assert full.count() == 4


def test_missing_age_fails_an_age_filter(spark, users):
    actions = frame(spark, [action("s", 3)])
    assert sessions.matching_spans(actions, users, TaskParams(start_age=0, end_age=200)).count() == 0


def test_rows_of_keeps_rows_once(spark, users):
    actions = frame(spark, [action("a", 1, 0), action("a", 1, 0), action("b", 99, 0)])
    spans = sessions.matching_spans(actions, users, TaskParams())
    kept = sessions.rows_of(actions, spans)
    assert kept.count() == 2 and kept.columns == actions.columns


def test_duration_bucket_edges(spark):
    lengths = [0, 1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61, 180, 181, 600, 601, 1800, 1801]
    table = spark.createDataFrame([(v, 100) for v in lengths], "visit_length bigint, step_length bigint")
    counts = histogram.session_counts(table).head().asDict()
    assert counts.pop("session_count") == len(lengths)
    assert counts.pop("30m") == 1 and counts.pop("60") == len(lengths)
    names = ["1s_3s", "4s_6s", "7s_9s", "10s_30s", "30s_60s", "1m_3m", "3m_10m", "10m_30m"]
    assert [counts[n] for n in names] == [2] * 8


def test_step_bucket_edges(spark):
    steps = [1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61]
    table = spark.createDataFrame([(0, v) for v in steps], "visit_length bigint, step_length bigint")
    counts = histogram.session_counts(table).head().asDict()
    assert [counts[n] for n in ("1_3", "4_6", "7_9", "10_30", "30_60", "60")] == [2, 2, 2, 2, 2, 1]
    assert sum(v for k, v in counts.items() if k[-1] in "sm") == 0


@pytest.mark.parametrize("part, total, expected", [(1, 200, 0.01), (23, 200, 0.12), (1, 8, 0.13)])
def test_ratios_round_half_up(spark, part, total, expected):
    table = spark.range(total).select(
        F.when(F.col("id") < part, 5).otherwise(0).alias("visit_length"), F.lit(1).alias("step_length")
    )
    assert histogram.session_histogram(table).head()["4s_6s"] == expected


def test_no_sessions_give_no_histogram(spark):
    empty = spark.createDataFrame([], "visit_length bigint, step_length bigint")
    assert histogram.session_histogram(empty).count() == 0


def _many_sessions(spark):
    hour = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)
    start = F.lit("2024-01-05").cast("timestamp_ntz") + F.make_dt_interval(hours=hour.cast("int"))
    return spark.range(3000).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_id"), start.alias("start_time")
    )


@pytest.mark.parametrize("digits", [1, 2, 3])
@pytest.mark.parametrize("size", [3, 100, 5000])
def test_sample_equals_ranking_whole_hours(spark, size, digits):
    table = _many_sessions(spark)
    drawn = {r[0] for r in sampling.session_sample(table, size, "x", digits).select("session_id").collect()}
    hours = {}
    for session, start in table.collect():
        hours.setdefault(start, []).append((hashlib.md5(f"{session}x".encode()).hexdigest(), session))
    expected = set()
    for group in hours.values():
        quota = min(len(group) * size // 3000, len(group))
        expected |= {s for _, s in sorted(group)[:quota]}
    assert drawn == expected
    quotas = sampling.hour_quotas(table, size)
    assert quotas.agg(F.sum("quota")).head()[0] == len(drawn)


def test_sample_ignores_partitioning(spark):
    table = _many_sessions(spark)
    one = sampling.session_sample(table, 50).collect()
    other = sampling.session_sample(table.repartition(7), 50).collect()
    assert sorted(one) == sorted(other)


def test_sample_of_one_crowded_hour(spark):
    table = spark.range(20_000).select(
        F.concat(F.lit("s"), "id").alias("session_id"),
        F.when(F.col("id") % 20 > 0, F.lit("2024-01-05 08:00:00")).otherwise(F.lit("2024-01-05 09:00:00"))
        .cast("timestamp_ntz").alias("start_time"),
    )
    drawn = [r[0] for r in sampling.session_sample(table, 5000, "q").select("session_id").collect()]
    by_draw = sorted((hashlib.md5(f"s{i}q".encode()).hexdigest(), f"s{i}") for i in range(20_000) if i % 20)
    assert {s for s in drawn if int(s[1:]) % 20} == {s for _, s in by_draw[:4750]}
    assert len(drawn) == 5000


def test_scan_bounds_are_inclusive(spark):
    actions = frame(spark, [action("s", 1, s) for s in (-1, 0, 10, 11)])
    hits = scans.action_scan(actions, "2024-01-05 9:00:00", "2024-01-05 09:00:10")
    assert hits.count() == 2
    assert scans.action_scan(actions, "2024-01-05", "2024-01-05").count() == 4
    assert scans.action_scan(actions, "2024-01-06", None).count() == 0
    assert scans.action_scan(actions, None, None).count() == 4


def test_raw_times_are_parsed(spark):
    raw = spark.createDataFrame(
        [("2024-01-05", t) for t in ("2024-01-05 9:05:07", "2024-01-05 10:00:00", "garbage")],
        "date string, action_time string",
    )
    checked = typed_actions(raw)
    assert [r["action_time"] for r in checked.quarantine.collect()] == ["garbage"]
    typed = checked.rows.orderBy("action_time").collect()
    assert [r["action_time"] for r in typed] == [
        dt.datetime(2024, 1, 5, 9, 5, 7),
        dt.datetime(2024, 1, 5, 10, 0, 0),
    ]
    assert typed[0]["date"] == DAY
