"""Registered queries that run a whole task, or store its input, and read back what was written."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators import adclicks, categories, sampling, scans, sessions
from footfall.plans import area_products_sql
from footfall.plans.area_products import run_area_products
from footfall.plans.session_analysis import Counted, run_session_analysis
from footfall.registry import settings as S
from footfall.registry.queries import query
from footfall.session import local_fallback, shared_folder
from footfall.sinks import lookups
from footfall.sources import buckets, star

SESSION_TABLES = (
    "session_aggr_stat",
    "session_random_extract",
    "session_detail",
    "top10_category",
    "top10_category_session",
    "top10_session_detail",
)


def _run(spark: SparkSession, folder: str) -> tuple[str, Counted]:
    work = local_fallback(spark)
    out = shared_folder(spark, "session-task", work)
    actions, users = star.user_visit_action(spark, folder), star.user_info(spark, folder)
    counted = run_session_analysis(actions, users, S.TASK, 1, out, sample_size=S.SAMPLE_SIZE, seed=S.SEED, work=work)
    return out, counted


@query
def task_session_results(spark: SparkSession, folder: str) -> DataFrame:
    """All tables of a session analysis, read back; each has its own columns, the others are NULL."""
    out, _ = _run(spark, folder)
    tables = [spark.read.parquet(os.path.join(out, t)).withColumn("result", F.lit(t)) for t in SESSION_TABLES]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


@query
def observed_action_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What the task has read, kept and written, observed while it ran."""
    _, counted = _run(spark, folder)
    rows = [("actions", counted.actions), ("sessions", counted.sessions), *counted.written.items()]
    found = [F.struct(F.lit(n).alias("counted"), F.lit(c).cast("long").alias("row_count")) for n, c in rows]
    return spark.range(1).select(F.inline(F.array(*found)))


@query
def task_area_products(spark: SparkSession, folder: str) -> DataFrame:
    """The table of an area ranking that was run twice, which replaces it."""
    out = shared_folder(spark, "area-task", local_fallback(spark))
    actions = star.user_visit_action(spark, folder)
    cities, info = star.city_info(spark, folder), star.product_info(spark, folder)
    for _ in range(2):
        run_area_products(actions, cities, info, S.TASK, 7, out, levels=S.AREA_LEVELS)
    return spark.read.parquet(os.path.join(out, "area_top3_product"))


@query
def area_top3_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The area ranking as SQL text over named views."""
    for name in ("user_visit_action", "city_info", "product_info"):
        getattr(star, name)(spark, folder).createOrReplaceTempView(name)
    return area_products_sql.area_top_products(spark, S.START, S.END, S.AREA_LEVELS, buckets=S.SALT_BUCKETS)


@query
def ad_count_point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts of the users with most clicks, out of a table that is laid out for lookups."""
    path = shared_folder(spark, "count-lookup", local_fallback(spark))
    counts = adclicks.user_daily_counts(star.ad_click_log(spark, folder))
    lookups.store_for_lookup(counts, path, "user_id")
    schema = "date DATE, user_id BIGINT, ad_id BIGINT, click_count BIGINT"
    stored = spark.read.schema(schema).parquet(path)
    most = stored.groupBy("user_id").agg(F.sum("click_count").alias("n")).orderBy(F.desc("n"), "user_id")
    users = [r.user_id for r in most.limit(S.LOOKED_UP).collect()]
    return lookups.look_up(spark, path, schema, "user_id", users)


@query
def session_bucketed_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Actions of sampled sessions, from a table stored by day and in buckets of the session."""
    path = shared_folder(spark, "bucketed-actions", local_fallback(spark))
    table = f"actions_{uuid.uuid4().hex}"
    stored = buckets.store_actions(star.user_visit_action(spark, folder), table, path, buckets=S.BUCKETS)
    scanned = scans.action_scan(stored.all(), S.START, S.END)
    spans = sessions.matching_spans(scanned, star.user_info(spark, folder), S.RANGE).select("session_id", "start_time")
    sample = sampling.session_sample(spans, S.SAMPLE_SIZE, S.SEED)
    return stored.each(lambda actions: categories.details_of(scans.action_scan(actions, S.START, S.END), sample))
