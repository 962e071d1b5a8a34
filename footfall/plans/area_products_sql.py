"""Top products per area as SQL text: named views, each on the one before, and the registered functions.

For those who work in SQL, step by step, on a session of their own. The result is that of ``plans.area_products``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from footfall.functions import sql
from footfall.operators.products import DEFAULT_LEVELS, LEVEL_LABELS, OWN_PRODUCT, THIRD_PARTY_PRODUCT

BASIC, SALTED, COUNTS, FULL = "click_product_basic", "click_product_salted", "area_product_click_count", "area_full_product_count"


def _level(levels: Mapping[str, Sequence[str]]) -> str:
    cases = []
    for label in ("A", "B", "C", "D"):
        areas = ", ".join("'" + a.replace("'", "\\'") + "'" for a in levels.get(label, ()))
        if areas:
            cases.append(f"WHEN area IN ({areas}) THEN '{LEVEL_LABELS[label]}'")
    return f"CASE {' '.join(cases)} ELSE '{LEVEL_LABELS['E']}' END" if cases else f"'{LEVEL_LABELS['E']}'"


def statements(levels: Mapping[str, Sequence[str]] = DEFAULT_LEVELS, *, buckets: int = 10, top: int = 3) -> list[str]:
    """The SQL of every step. The views ``user_visit_action``, ``city_info`` and ``product_info`` must be there.

    The days ``:start`` and ``:end`` of the scan, both included, are to be filled in. Groups are first counted in ``buckets``
    parts each, as the clicks of one product may be very many. The part follows from the row's session and time, so a task
    that is run again deals its rows out as before.
    """
    return [
        f"""CREATE OR REPLACE TEMPORARY VIEW {BASIC} AS
            SELECT c.city_id, c.city_name, c.area, a.click_product_id AS product_id, a.session_id, a.action_time
            FROM user_visit_action a JOIN city_info c ON a.city_id = c.city_id
            WHERE a.click_product_id IS NOT NULL
              AND a.date BETWEEN DATE :start AND DATE :end""",
        f"""CREATE OR REPLACE TEMPORARY VIEW {SALTED} AS
            SELECT part, count(*) AS click_count,
                   collect_set(concat_long_string(city_id, city_name, ':')) AS cities
            FROM (SELECT *, random_prefix(concat(area, '_', product_id), {int(buckets)},
                                          concat(session_id, action_time)) AS part FROM {BASIC})
            GROUP BY part""",
        f"""CREATE OR REPLACE TEMPORARY VIEW {COUNTS} AS
            SELECT regexp_replace(pair, '_[0-9]+$', '') AS area,
                   CAST(regexp_extract(pair, '_([0-9]+)$', 1) AS BIGINT) AS product_id, click_count, city_infos
            FROM (SELECT remove_random_prefix(part) AS pair, sum(click_count) AS click_count,
                         array_join(sort_array(array_distinct(flatten(collect_list(cities)))), ',') AS city_infos
                  FROM {SALTED} GROUP BY remove_random_prefix(part))""",
        f"""CREATE OR REPLACE TEMPORARY VIEW {FULL} AS
            SELECT t.*, p.product_name,
                   if(try_cast(json_field(p.info, 'product_status') AS INT) = 0,
                      '{OWN_PRODUCT}', '{THIRD_PARTY_PRODUCT}') AS product_status
            FROM {COUNTS} t JOIN product_info p ON t.product_id = p.id""",
        f"""SELECT area, {_level(levels)} AS area_level, product_id, click_count, city_infos, product_name, product_status
            FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) AS place
                  FROM {FULL})
            WHERE place <= {int(top)}""",
    ]


def area_top_products(
    spark: SparkSession,
    start: str,
    end: str,
    levels: Mapping[str, Sequence[str]] = DEFAULT_LEVELS,
    *,
    buckets: int = 10,
    top: int = 3,
) -> DataFrame:
    """Run the steps on the session's views and return the last one's rows. ``start`` and ``end`` are days."""
    sql.register(spark)
    first, *views, last = statements(levels, buckets=buckets, top=top)
    for name, day in (("start", start), ("end", end)):
        first = first.replace(f":{name}", f"'{str(day)[:10]}'")  # a view's text can't hold a parameter
    for view in (first, *views):
        spark.sql(view)
    return spark.sql(last)
