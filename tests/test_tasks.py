"""Whole tasks: results put in place together, counters that ride on the write, actions in buckets, hot keys, SQL text."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from footfall.functions import sql
from footfall.operators import categories, products, scans, sessions
from footfall.operators.skew import hot_keys
from footfall.plans import area_products_sql
from footfall.registry import settings as S
from footfall.sinks import lookups
from footfall.sinks.tables import TaskResults, replace_task
from footfall.sources import buckets, star


def _ids(df):
    return sorted(r[0] for r in df.collect())


def _failing(spark):
    return spark.range(3).select(F.when(F.col("id") >= 0, F.raise_error(F.lit("the task dies"))).otherwise(1).alias("id"))


def _left(path):
    return sorted(os.listdir(path))


def test_a_write_that_fails_leaves_the_earlier_rows(spark, tmp_path):
    path = str(tmp_path / "out" / "t")
    assert _ids(replace_task(spark.range(3), 1, path)) == [0, 1, 2]
    with pytest.raises(Exception, match="the task dies"):
        replace_task(_failing(spark), 1, path)
    assert _ids(spark.read.parquet(path).select("id")) == [0, 1, 2]
    assert _left(path) == ["task_id=1"]
    assert _ids(replace_task(spark.range(2), 1, path)) == [0, 1]


def test_tables_of_a_run_come_together_or_not_at_all(spark, tmp_path):
    out = str(tmp_path / "out")

    def run(rows, last):
        with TaskResults(spark, out, 5) as results:
            first = results.write(spark.range(rows), "a")
            assert first.count() == rows
            results.write(last, "b")
        return results.written

    assert run(2, spark.range(4)) == {"a": 2, "b": 4}
    with pytest.raises(Exception, match="the task dies"):
        run(7, _failing(spark))
    assert spark.read.parquet(f"{out}/a").count() == 2 and spark.read.parquet(f"{out}/b").count() == 4
    assert run(0, spark.range(1)) == {"a": 0, "b": 1}
    assert spark.read.parquet(f"{out}/a").count() == 0


def test_a_swap_that_fails_is_taken_back(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    for table in ("a", "b"):
        replace_task(spark.range(2), 5, f"{out}/{table}")
    from footfall.sinks import tables

    rename, calls = tables.rename, []

    def dies_once(session, source, target):
        calls.append(target)
        if len(calls) == 4:
            raise OSError("no more renames")
        rename(session, source, target)

    monkeypatch.setattr(tables, "rename", dies_once)
    with pytest.raises(OSError):
        with TaskResults(spark, out, 5) as results:
            results.write(spark.range(9), "a")
            results.write(spark.range(9), "b")
    assert [spark.read.parquet(f"{out}/{t}").count() for t in ("a", "b")] == [2, 2]
    assert _left(f"{out}/a") == _left(f"{out}/b") == ["task_id=5"]


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path, table = str(tmp_path_factory.mktemp("buckets")), f"actions_{uuid.uuid4().hex}"
    actions = star.user_visit_action(spark, sf_dir)
    # One session has a third of all actions.
    hot = actions.limit(1).selectExpr("session_id AS s").head().s
    many = actions.where(F.col("session_id") == hot).limit(1).crossJoin(spark.range(actions.count() // 2)).drop("id")
    actions = actions.unionByName(many)
    early = actions.where("date < DATE '2024-01-20'")
    buckets.store_actions(early, table, f"{path}/t", buckets=4, hot_share=0.1)
    buckets.add_days(actions.where("date >= DATE '2024-01-20'"), table, hot_share=0.1)
    yield buckets.read_actions(spark, table, actions.columns), actions, hot
    spark.sql(f"DROP TABLE {table}")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_actions_are_the_same_and_few_files(stored):
    stored, actions, hot = stored
    assert stored.all().exceptAll(actions).count() == actions.exceptAll(stored.all()).count() == 0
    assert {r[0] for r in stored.hot.select("session_id").distinct().collect()} == {hot}
    assert stored.bucketed.where(F.col("session_id") == hot).count() == 0 < stored.hot.count()
    per_day = {}
    for name in stored.bucketed.inputFiles():
        day = name.split("date=")[1].split("/")[0]
        per_day[day] = per_day.get(day, 0) + 1
    assert len(per_day) == 30 and max(per_day.values()) <= 4


def test_session_joins_shuffle_no_actions(spark, stored):
    stored, actions, hot = stored
    scanned = scans.action_scan(stored.bucketed, S.START, S.END)
    few = spark.createDataFrame([("s_1_2024-01-05",), ("s_2_2024-01-06",), (hot,)], "session_id string")
    found = stored.each(lambda part: categories.details_of(part, few))
    want = categories.details_of(actions, few)
    assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0 < found.count()
    for key, value in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
        spark.conf.set(key, value)
    try:
        for df in (categories.details_of(scanned, few), sessions.rows_of(scanned, few)):
            plan = _plan(df)
            join, scan = plan.index("SortMergeJoin"), plan.index("FileScan parquet")
            assert "Exchange" not in plan[join:scan].split("Scan ExistingRDD")[0] and "Bucketed: true" in plan
            assert "PartitionFilters: [isnotnull(date" in plan and "2024-01-05" in plan
        rolled = _plan(scanned.groupBy("session_id").agg(F.min("action_time")))
        assert "Exchange" not in rolled
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_keys_are_found_and_only_they_are_split(spark):
    rows = spark.range(0, 30_000, numPartitions=6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7L WHEN id % 50 = 1 THEN 8L WHEN id % 1000 = 2 THEN NULL ELSE 1000 + id END AS product_id",
        "id % 3 AS city_id",
        "concat('c', id % 3) AS city_name",
        "CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END AS area",
        "concat('s', id) AS session_id",
    )
    assert hot_keys(rows, "product_id", 0.3) == [7]
    assert sorted(hot_keys(rows, "product_id", 0.01)) == [7, 8]
    assert hot_keys(rows.where("product_id > 1000"), "product_id", 0.01) == []
    assert hot_keys(rows.where("product_id IS NULL"), "product_id", 0.1) == []
    with pytest.raises(ValueError):
        hot_keys(rows, "product_id", 0.001)
    basic = rows.where("product_id IS NOT NULL")
    split = products.area_product_counts_hot_keys(basic, 8, ("session_id",), 0.3)
    direct = products.area_product_counts_direct(basic)
    assert split.exceptAll(direct).count() == direct.exceptAll(split).count() == 0
    plan = _plan(split)
    # Two exchanges of the hot product's parts; one of all others.
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("salt") > 0


def test_sql_steps_with_and_without_a_row_key(spark, sf_dir):
    for name in ("user_visit_action", "city_info", "product_info"):
        getattr(star, name)(spark, sf_dir).createOrReplaceTempView(name)
    got = area_products_sql.area_top_products(spark, S.START, S.END, S.AREA_LEVELS)
    clicks = scans.click_scan(star.user_visit_action(spark, sf_dir), S.START, S.END)
    counts = products.area_product_counts(clicks, star.city_info(spark, sf_dir))
    want = products.top_products(counts, star.product_info(spark, sf_dir), S.AREA_LEVELS)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    sql.register(spark)
    drawn = spark.sql("SELECT random_prefix('a_b', 5) AS p FROM range(200)")
    parts = {tuple(r.p.split("_", 1)) for r in drawn.collect()}
    assert parts == {(str(n), "a_b") for n in range(5)}
    assert {r[0] for r in drawn.selectExpr("remove_random_prefix(p)").collect()} == {"a_b"}
    keyed = spark.sql("SELECT random_prefix('a', 5, CAST(id AS STRING)) AS p FROM range(50)")
    assert keyed.collect() == keyed.collect()


def _scanned(df):
    """Rows that came out of the scans of a frame that is run for it."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves() if "AdaptiveSparkPlan" not in plan.nodeName() else plan.executedPlan().collectLeaves()
    for n in range(leaves.size()):
        metric = leaves.apply(n).metrics().get("numOutputRows")
        rows += metric.get().value() if metric.isDefined() else 0
    return rows


def test_lookups_skip_row_groups(spark, tmp_path):
    schema = "date DATE, user_id BIGINT, ad_id BIGINT, click_count BIGINT"
    counts = spark.range(40_000).selectExpr(
        "date_add(DATE '2024-01-01', CAST(id % 2 AS INT)) AS date", "2 * (id div 2) AS user_id", "id % 7 AS ad_id", "id AS click_count"
    )
    path = str(tmp_path / "counts")
    lookups.store_for_lookup(counts, path, "user_id", group_bytes=20_000, keys_a_group=1000)

    def find(keys, days=None):
        return lookups.look_up(spark, path, schema, "user_id", keys, days)

    assert sorted(r.user_id for r in find([10, 30_000, 11]).collect()) == [10, 10, 30_000, 30_000]
    assert 0 < _scanned(find([10, 30_000])) < 40_000 / 4
    day = find([10], ["2024-01-02"])
    assert [r.click_count for r in day.collect()] == [11]
    assert "2024-01-02" in _plan(day).split("PartitionFilters: [")[1].split("]")[0]
    # Keys inside the range of every row group, but in none: only the filters can tell.
    assert _scanned(find([n for n in range(1, 39_999, 400)])) < 40_000 / 4
    with pytest.raises(ValueError):
        find(range(2000))
