"""Categories, page flows and product rankings on hand-written rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators import categories, funnel, products
from footfall.registry import settings as S
from footfall.operators.scans import action_scan, click_scan
from footfall.sources import star

START = dt.datetime(2024, 1, 5, 9, 0, 0)


def action(session, time, page=1, click=None, orders=None, pays=None, product=None, city=0):
    return (time.date(), 1, session, page, time, None, click, product, orders, None, pays, None, city)


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.USER_VISIT_ACTION)


def test_three_key_order(spark):
    counts = spark.createDataFrame(
        [(1, 12, 90, 80), (2, 20, 11, 70), (3, 12, 95, 10), (9, 20, 11, 70)],
        "category_id bigint, click_count bigint, order_count bigint, pay_count bigint",
    )
    assert [r["category_id"] for r in categories.top_categories(counts, 3).collect()] == [2, 9, 3]


def test_comma_lists(spark):
    lists = ["5", "5,6", "5,", ",", None]
    actions = frame(spark, [action("s", START, orders=text) for text in lists])
    assert [tuple(r) for r in categories.category_counts(actions).orderBy("category_id").collect()] == [
        (5, 0, 3, 0),
        (6, 0, 1, 0),
    ]


def test_both_counting_plans_agree(spark, sf_dir):
    actions = star.user_visit_action(spark, sf_dir)
    one = categories.category_counts(actions).collect()
    other = categories.category_counts_joined(actions).collect()
    assert sorted(one) == sorted(other)


def test_top_sessions_break_ties_by_id(spark):
    clicks = [("b", 7, 2), ("a", 7, 2), ("c", 7, 3), ("d", 8, 9)]
    actions = frame(spark, [action(s, START, click=c) for s, c, n in clicks for _ in range(n)])
    few = spark.createDataFrame([(7,)], "category_id bigint")
    top = categories.top_sessions(categories.session_clicks(actions, few), 2)
    assert sorted(tuple(r) for r in top.collect()) == [(7, "a", 2), (7, "c", 3)]
    assert categories.details_of(actions, top).count() == 5


def _brute_pairs(rows):
    by_session = {}
    for r in rows:
        by_session.setdefault(r[2], []).append((r[4], r[3]))
    pairs = {}
    for views in by_session.values():
        views.sort()
        for (_, a), (_, b) in zip(views, views[1:]):
            pairs[(a, b)] = pairs.get((a, b), 0) + 1
    return pairs


def _random_views():
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        # One session holds a third of all views; many views share a second; some hours are empty.
        session = "hot" if rng.random() < 0.34 else f"s{rng.randrange(60)}"
        time = START + dt.timedelta(hours=rng.choice([0, 1, 2, 5, 30]), seconds=rng.randrange(60) * 60)
        rows.append(action(session, time, page=rng.randrange(4)))
    return rows


@pytest.mark.parametrize("minutes", [1, 60, 100_000_000])
def test_page_pairs_equal_brute_force(spark, minutes):
    rows = _random_views()
    counted = funnel.pair_counts(funnel.page_pairs(frame(spark, rows).repartition(5), minutes))
    assert {(r[0], r[1]): r[2] for r in counted.collect()} == _brute_pairs(rows)


@pytest.mark.parametrize("minutes", [1, 60])
def test_conversion_equals_pair_counts(spark, minutes):
    rows = _random_views()
    flow = (1, 2, 3, 3, 1, 2)
    pairs = _brute_pairs(rows)
    steps = funnel.flow_conversion(frame(spark, rows), flow, minutes).orderBy("step").collect()
    assert [s["pv"] for s in steps] == [pairs.get(p, 0) for p in funnel.flow_pairs(flow)]
    assert steps[0]["prev_pv"] == sum(r[3] == 1 for r in rows)
    assert [s["prev_pv"] for s in steps[1:]] == [s["pv"] for s in steps[:-1]]
    matched = funnel.match_flow(funnel.page_pairs(frame(spark, rows)), flow)
    expected = {p: pairs[p] for p in set(funnel.flow_pairs(flow)) if p in pairs}
    assert {(r[0], r[1]): r[2] for r in funnel.pair_counts(matched).collect()} == expected


def _flow(spark, pages, flow):
    rows = [action("s", START + dt.timedelta(seconds=i), page=p) for i, p in enumerate(pages)]
    return [tuple(r) for r in funnel.flow_conversion(frame(spark, rows), flow).orderBy("step").collect()]


def test_missing_pair_counts_zero_and_divides_to_null(spark):
    assert _flow(spark, [1, 2, 9, 3, 4], (1, 2, 3, 4)) == [
        (1, "1_2", 1, 1, 1.0),
        (2, "2_3", 0, 1, 0.0),
        (3, "3_4", 1, 0, None),
    ]


def test_flow_without_start_page(spark):
    assert _flow(spark, [2, 3], (1, 2, 3)) == [(1, "1_2", 0, 0, None), (2, "2_3", 1, 0, None)]


def test_no_views_at_all(spark):
    empty = spark.createDataFrame([], schemas.USER_VISIT_ACTION)
    assert [r["pv"] for r in funnel.flow_conversion(empty, (1, 2)).collect()] == [0]


def test_repeated_page_and_equal_times(spark):
    rows = [action("s", START, page=p) for p in (3, 1, 2)] + [action("s", START, page=2)]
    pairs = funnel.pair_counts(funnel.page_pairs(frame(spark, rows)))
    assert {(r[0], r[1]): r[2] for r in pairs.collect()} == {(1, 2): 1, (2, 2): 1, (2, 3): 1}


def test_flow_steps(spark):
    steps = funnel.flow_steps(spark.range(1), "3, 5,2")
    assert [tuple(r) for r in steps.collect()] == [(1, 3, 5), (2, 5, 2)]
    assert funnel.flow_steps(spark.range(1), "3").count() == 0


@pytest.mark.parametrize("buckets", [1, 4, 16])
def test_salted_counts_equal_direct_counts(spark, sf_dir, buckets):
    actions = action_scan(star.user_visit_action(spark, sf_dir), S.START, S.END)
    key = ("session_id", "action_time")
    cities = star.city_info(spark, sf_dir)
    basic = products.area_clicks(click_scan(actions, None, None, keep=key), cities)
    columns = ["area", "product_id", "click_count", "city_infos"]
    direct = sorted(products.area_product_counts_direct(basic).select(columns).collect())
    assert sorted(products.area_product_counts_salted(basic, buckets, key).select(columns).collect()) == direct
    clicks = click_scan(actions, None, None)
    assert sorted(products.area_product_counts(clicks, cities).select(columns).collect()) == direct


@pytest.mark.parametrize(
    "info, expected",
    [
        ('{"product_status":0}', products.OWN_PRODUCT),
        ('{"product_status":1}', products.THIRD_PARTY_PRODUCT),
        ('{"product_status":"x"}', products.THIRD_PARTY_PRODUCT),
        ('{"product_status"', products.THIRD_PARTY_PRODUCT),
        (None, products.THIRD_PARTY_PRODUCT),
    ],
)
def test_product_status(spark, info, expected):
    table = spark.createDataFrame([(info,)], "info string")
    assert table.select(products.product_status(F.col("info"))).head()[0] == expected


@pytest.mark.parametrize(
    "area, level",
    [
        ("China South", "A级地区"),
        ("China East", "A级地区"),
        ("China North", "B级地区"),
        ("China Middle", "B级地区"),
        ("WEST NORTH", "C级地区"),
        ("WEST SOUTH", "D级地区"),
        ("elsewhere", "E级地区"),
        (None, "E级地区"),
    ],
)
def test_area_level(spark, area, level):
    table = spark.createDataFrame([(area,)], "area string")
    assert table.select(products.area_level(F.col("area"), products.DEFAULT_LEVELS)).head()[0] == level


def test_top_products_need_a_known_product(spark):
    counts = spark.createDataFrame(
        [("n", 1, 9, "0:a"), ("n", 2, 9, "0:a"), ("n", 3, 1, "0:a"), ("n", 4, 2, "0:a"), ("n", 5, 99, "0:a")],
        "area string, product_id bigint, click_count bigint, city_infos string",
    )
    info = spark.createDataFrame([(i, f"p{i}", None) for i in (1, 2, 3, 4)], schemas.PRODUCT_INFO)
    assert [r["product_id"] for r in products.top_products(counts, info).orderBy("product_id").collect()] == [1, 2, 4]


def test_a_burst_inside_one_minute_is_split(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(2000):
        hot = rng.random() < 0.8
        time = START + dt.timedelta(seconds=rng.randrange(55) if hot else rng.randrange(7200))
        rows.append(action("hot" if hot or rng.random() < 0.5 else f"s{rng.randrange(9)}", time, page=rng.randrange(5)))
    actions = frame(spark, rows)
    counted = funnel.pair_counts(funnel.page_pairs(actions, sampled=1, burst=50))
    assert {(r[0], r[1]): r[2] for r in counted.collect()} == _brute_pairs(rows)
    keys = funnel._sliced(actions, 10, 1, 50).groupBy("session_id", "slice", "second").count()
    assert keys.agg(F.max("count")).head()[0] < 100
    unsplit = funnel._sliced(actions, 10).groupBy("session_id", "slice", "second").count()
    assert unsplit.agg(F.max("count")).head()[0] > 1000
