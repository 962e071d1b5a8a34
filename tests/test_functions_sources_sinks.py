"""Scalar functions, readers, writers and whole analyses."""

import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions import documents, sql, texts, times
from footfall.operators import activity, adclicks, categories, funnel, histogram, products, sampling, sessions
from footfall.operators.scans import action_scan, click_scan
from footfall.params import TaskParams
from footfall.plans.area_products import run_area_products
from footfall.plans.page_flow import run_page_flow
from footfall.plans.session_analysis import run_session_analysis
from footfall.plans.user_activity import run_user_activity
from footfall.registry import settings as S
from footfall.session import shared_folder
from footfall.sinks import render, tables
from footfall.sources import jsonl, star
from footfall.sources.adlog import parse_ad_log
from footfall.sources.streams import kafka_options
from footfall.sources.tables import jdbc_options, named_view
from footfall.sources.tasks import load_task, parse_task_params


def values(spark, column, *inputs):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in table.orderBy("i").select(column(F.col("v"))).collect()]


def test_times(spark):
    assert values(spark, times.parse_time_ntz, "2024-01-05 9:05:07", "2024-01-05 10:00:00", "garbage", None) == [
        dt.datetime(2024, 1, 5, 9, 5, 7),
        dt.datetime(2024, 1, 5, 10),
        None,
        None,
    ]
    assert values(spark, times.parse_date_key, "20240105", "2024x", None) == [dt.date(2024, 1, 5), None, None]


@pytest.mark.parametrize(
    "cycle, steps, expected",
    [
        ("year", -1, "2023-01-01"),
        ("month", -1, "2024-02-01"),
        ("month", 0, "2024-03-01"),
        ("week", 0, "2024-03-11"),  # ISO weeks: the Sunday still belongs to the week before
        ("week", -1, "2024-03-04"),
        ("day", -17, "2024-02-29"),
    ],
)
def test_cycle_start(spark, cycle, steps, expected):
    column = times.cycle_start(F.lit("2024-03-17 23:59:59").cast("timestamp"), cycle, steps)
    assert str(spark.range(1).select(column.cast("date")).head()[0]) == expected


def test_unknown_cycle():
    with pytest.raises(ValueError):
        times.cycle_start(None, "decade", 0)


def test_texts(spark):
    assert values(spark, texts.is_empty, "", None, "a") == [True, True, False]
    assert values(spark, texts.trim_comma, ",a,b,", ",,a", "a", "") == ["a,b", ",a", "a", ""]
    assert values(spark, texts.two_digits, "7", "12", "123") == ["07", "12", "0123"]
    assert values(spark, texts.split_ids, "5,6,", ",", "x,7", None) == [[5, 6], [], [7], None]


def test_packed_records(spark):
    def get(v):
        return texts.get_field(v, "b")

    assert values(spark, get, "a=1|b=2", "b=|a=1", "a=1", "b=x=y|b=3", "b=1|b=2", "", None) == [
        "2",
        None,
        None,
        "3",
        "1",
        None,
        None,
    ]

    def put(v):
        return texts.set_field(v, "b", F.lit("9"))

    assert values(spark, put, "a=1|b=2", "b=|b=3", "a=1|c=2|", "b") == ["a=1|b=9", "b=9|b=3", "a=1|c=2", "b=9"]


def test_json(spark):
    def field(v):
        return documents.json_field(v, "s")

    assert values(spark, field, '{"s":0}', '{"s":"x"}', "{bad", "{}", None) == ["0", "x", None, None, None]
    assert values(spark, documents.json_strings, '["a","b"]') == [["a", "b"]]


def test_sql_names(spark):
    sql.register(spark)
    row = spark.sql(
        "SELECT concat_long_string(7, 'x', ':'), json_field('{\"s\":1}', 's'), trim_comma(',a,'),"
        " remove_random_prefix(random_prefix('a_b', 10, 'row 1'))"
    ).head()
    assert tuple(row) == ("7:x", "1", "a", "a_b")
    prefixes = spark.sql("SELECT DISTINCT split(random_prefix('k', 4, CAST(id AS STRING)), '_')[0] FROM range(200)")
    assert {r[0] for r in prefixes.collect()} == {"0", "1", "2", "3"}


def test_ad_log_lines(spark):
    lines = [
        "1704879000456 North Harbour 41 8",
        "1704879000456 North Harbour 41",
        "1704879000456 North Harbour x 8",
        "later North Harbour 41 8",
        "99999999999999999 North Harbour 41 8",
        "-5 North Harbour 41 8",
        "1704879000456 North Harbour 41 8 9",
        "",
    ]
    parsed = parse_ad_log(spark.createDataFrame([(v,) for v in lines], "value string"))
    assert [tuple(r)[1:] for r in parsed.clicks.collect()] == [("North", "Harbour", 41, 8)]
    assert parsed.clicks.select(F.unix_millis("ts")).head()[0] == 1704879000456
    assert sorted(r[0] for r in parsed.quarantine.collect()) == sorted(lines[1:])


def test_json_lines_with_a_malformed_line(spark, tmp_path):
    good = '{"logId": 71,"userId": 5, "actionTime": "2024-02-29 7:08:09", "actionType": 1, "purchaseMoney": 12.5}'
    bad = good.replace(": 71,", ": 071,")
    late = good.replace("2024-02-29 7:08:09", "noon")
    (tmp_path / "log.json").write_text("\n".join([good, bad, "", "   ", late]) + "\n")
    checked = jsonl.read_json_lines(spark, str(tmp_path), schemas.USER_ACTION_LOG_JSON, times=("actionTime",))
    assert [tuple(r) for r in checked.rows.collect()] == [(71, 5, dt.datetime(2024, 2, 29, 7, 8, 9), 1, 12.5)]
    assert sorted(r["line"] for r in checked.quarantine.collect()) == sorted([bad, late])
    lines = spark.createDataFrame([(None,), ("",), (good,)], "value string")
    parsed = jsonl.action_log(lines)
    assert parsed.rows.count() == 1
    assert [r["line"] for r in parsed.quarantine.collect()] == [None]


def test_user_base_lines(spark, tmp_path):
    (tmp_path / "users.json").write_text('{"userId": 9, "username": "nine", "registTime": "2024-03-01 06:30:00"}\n')
    checked = jsonl.user_base(spark.read.text(str(tmp_path)))
    assert tuple(checked.rows.head()) == (9, "nine", dt.datetime(2024, 3, 1, 6, 30))


def test_task_records(spark):
    param = (
        '{"startDate":"2024-01-02 08:00:00","endDate":"2024-01-28 20:00:00","startAge":21,"endAge":"64",'
        '"keywords":"tea,rice","categoryIds":"4,9","targetPageFlow":"2,5,7","sex":""}'
    )
    tasks = spark.createDataFrame([(1, "a", None, None, None, "1", "1", param)], schemas.TASK)
    loaded = load_task(tasks, 1)
    assert loaded == TaskParams(
        start_date="2024-01-02 08:00:00",
        end_date="2024-01-28 20:00:00",
        start_age=21,
        end_age=64,
        keywords=("tea", "rice"),
        category_ids=(4, 9),
        target_page_flow=(2, 5, 7),
    )
    assert load_task(tasks, 2) is None
    row = parse_task_params(tasks).head()
    assert (row["start_age"], row["end_age"], row["category_ids"], row["cycle"]) == (21, 64, [4, 9], None)


def test_reader_options():
    options = jdbc_options("u", "t", partition_column="id", bounds=(0, 9), partitions=3)
    assert options["numPartitions"] == "3" and options["upperBound"] == "9"
    with pytest.raises(ValueError):
        jdbc_options("u", "t", partition_column="id")
    assert kafka_options("h:1", "a, b,", max_offsets_per_trigger=5)["subscribe"] == "a,b"
    with pytest.raises(ValueError):
        kafka_options("h:1", " , ")


def test_replacing_groups(spark, tmp_path):
    path = str(tmp_path / "t")

    def frame(*rows):
        return spark.createDataFrame(rows, "g int, v int")

    tables.replace_groups(frame((1, 1), (2, 2)), path, ["g"])
    tables.replace_groups(frame((2, 3), (3, 4)), path, ["g"])
    assert sorted((r["g"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 3), (3, 4)]
    tables.append(frame((1, 9)), path, ["g"])
    assert tables.first_rows(spark.read.parquet(path), 2).count() == 2
    assert spark.read.parquet(path).count() == 4


def test_rendered_rates(spark):
    rates = spark.createDataFrame(
        [(2, "2_1", 0.5), (1, "1_2", None), (3, "1_2", 0.25)], "step int, page_split string, convert_rate double"
    )
    assert render.packed_rates(rates).head()[0] == "1_2=|2_1=0.5|1_2=0.25"
    assert json.loads(render.json_rates(rates).head()[0]) == [{"2_1": 0.5, "1_2": 0.25}]


def test_blacklist_filter_keeps_clicks_without_user(spark):
    clicks = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "user_id bigint, x string")
    listed = spark.createDataFrame([(1,), (1,)], "user_id bigint")
    assert sorted(r["x"] for r in adclicks.without_blacklisted(clicks, listed).collect()) == ["b", "c"]


def test_named_view(spark):
    named_view(spark.range(3), "three")
    assert spark.table("three").count() == 3


class _Session:
    """Just the settings of a session; a running one does not let this setting be changed."""

    def __init__(self, folder):
        self.conf = self
        self.folder = folder

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


def test_shared_folder(tmp_path):
    named = _Session("/shared")
    folder = shared_folder(named, "x", str(tmp_path))
    assert folder.startswith("/shared/x-") and folder != shared_folder(named, "x", str(tmp_path))
    assert shared_folder(_Session(None), "x", str(tmp_path)).startswith(str(tmp_path))
    with pytest.raises(ValueError):
        shared_folder(_Session(None), "x")


def _written(spark, path):
    return sorted(map(str, spark.read.parquet(str(path)).drop("task_id").collect()))


def _rows(df):
    return sorted(map(str, df.collect()))


def test_whole_session_analysis(spark, sf_dir, tmp_path):
    actions, users = star.user_visit_action(spark, sf_dir), star.user_info(spark, sf_dir)
    params = TaskParams(start_date=S.START, end_date=S.END, start_age=20, end_age=60)
    out, work = tmp_path / "out", tmp_path / "work"
    for task_id in (1, 1, 2):
        run_session_analysis(actions, users, params, task_id, str(out), sample_size=800, seed="3", work=str(work))

    scanned = action_scan(actions, S.START, S.END)
    kept_sessions = sessions.filter_sessions(sessions.session_rollup(scanned, users), params)
    first = {t.name: spark.read.parquet(str(t)).where("task_id = 1").drop("task_id") for t in out.iterdir()}
    assert _rows(first["session_aggr_stat"]) == _rows(histogram.session_histogram(kept_sessions))
    columns = ["session_id", "start_time", "search_keywords", "click_category_ids"]
    sample = sampling.session_sample(kept_sessions.select(*columns), 800, "3")
    assert sample.count() > 0
    assert _rows(first["session_random_extract"]) == _rows(sample)
    detail = scanned.join(sample.select("session_id"), "session_id", "left_semi")
    assert _rows(first["session_detail"]) == _rows(detail.select(first["session_detail"].columns))
    kept = sessions.rows_of(scanned, kept_sessions)
    top = categories.top_categories(categories.category_counts(kept))
    assert _rows(first["top10_category"]) == _rows(top)
    best = categories.top_sessions(categories.session_clicks(kept, top))
    assert _rows(first["top10_category_session"]) == _rows(best)
    assert first["top10_session_detail"].count() == categories.details_of(scanned, best).count()


def test_whole_page_flow_and_products(spark, sf_dir, tmp_path):
    actions = star.user_visit_action(spark, sf_dir)
    params = TaskParams(start_date=S.START, end_date=S.END, target_page_flow=S.FLOW)
    out = str(tmp_path / "out")
    text = run_page_flow(actions, params, 3, out, work=str(tmp_path / "work")).head()[0]
    rates = funnel.flow_conversion(action_scan(actions, S.START, S.END), S.FLOW)
    assert json.loads(text) == [{r["page_split"]: r["convert_rate"] for r in rates.collect()}]
    assert _written(spark, tmp_path / "out" / "page_split_convert_rate") == _rows(render.packed_rates(rates))
    with pytest.raises(ValueError):
        run_page_flow(actions, TaskParams(target_page_flow=(1,)), 3, out)

    cities, info = star.city_info(spark, sf_dir), star.product_info(spark, sf_dir)
    run_area_products(actions, cities, info, params, 3, out, levels=S.AREA_LEVELS)
    counts = products.area_product_counts(click_scan(actions, S.START, S.END), cities)
    expected = products.top_products(counts, info, S.AREA_LEVELS)
    assert _written(spark, tmp_path / "out" / "area_top3_product") == _rows(expected)


def test_results_without_rows_replace_and_start_tables(spark, sf_dir, tmp_path):
    actions, users = star.user_visit_action(spark, sf_dir), star.user_info(spark, sf_dir)
    cities, info = star.city_info(spark, sf_dir), star.product_info(spark, sf_dir)
    log, base = star.user_action_log(spark, sf_dir), star.user_base_info(spark, sf_dir)
    full = TaskParams(start_date=S.START, end_date=S.END, target_page_flow=S.FLOW, cycle="month")
    none = TaskParams(start_date="1999-01-01", end_date="1999-01-02", target_page_flow=S.FLOW, cycle="month")
    work = str(tmp_path / "work")

    def run(params, out, as_of):
        run_session_analysis(actions, users, params, 3, out, sample_size=20_000, work=work)
        run_page_flow(actions, params, 3, out, work=work)
        run_area_products(actions, cities, info, params, 3, out, levels=S.AREA_LEVELS)
        run_user_activity(log, base, params, 3, out, as_of=as_of)

    def counts(out):
        return {t.name: spark.read.parquet(str(t)).count() for t in pathlib.Path(out).iterdir()}

    first = str(tmp_path / "first")
    run(none, first, dt.datetime(1999, 1, 2))
    empty = counts(first)
    assert empty.pop("page_split_convert_rate") == 1  # the rates of a flow that nobody took
    assert set(empty.values()) == {0} and len(empty) == 13
    again = str(tmp_path / "again")
    run(full, again, dt.datetime(2024, 1, 30))
    assert all(counts(again).values())
    run(none, again, dt.datetime(1999, 1, 2))
    left = counts(again)
    assert left.pop("page_split_convert_rate") == 1 and set(left.values()) == {0}


def test_odd_amounts_neither_stop_nor_spoil_a_sum(spark):
    rows = [(1, 1e12), (1, 0.25), (1, float("nan")), (1, None), (2, 1e40), (2, float("inf")), (2, 3.0), (3, 0.00000004)]
    log = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "logId long, userId long, purchaseMoney double")
    log = log.selectExpr("*", "1 AS actionType", "TIMESTAMP_NTZ '2024-01-06 10:00:00' AS actionTime")
    users = spark.createDataFrame([(i, f"u{i}") for i in (1, 2, 3)], "userId long, username string")
    got = {r["userId"]: r["totalPurchaseMoney"] for r in activity.top_spend(log, users, ("2024-01-05", "2024-01-07")).collect()}
    assert got == {1: 1e12 + 0.25, 2: 3.0, 3: 0.0}
    assert activity.unusable_purchases(log, ("2024-01-05", "2024-01-07")).count() == 3


def test_setting_a_field_to_nothing_keeps_it(spark):
    row = spark.range(1).select(texts.set_field(F.lit("a=1|b=2"), "b", F.lit(None).cast("string"))).head()
    assert row[0] == "a=1|b="
