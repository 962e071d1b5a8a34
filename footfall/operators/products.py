"""The most clicked products of each area."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.documents import json_field
from footfall.functions.texts import concat_long_string, join_sorted, salt
from footfall.operators.skew import hot_keys

# Labels of the results, and which areas belong to which level.
LEVEL_LABELS = {"A": "A级地区", "B": "B级地区", "C": "C级地区", "D": "D级地区", "E": "E级地区"}
DEFAULT_LEVELS = {
    "A": ("China South", "China East"),
    "B": ("China North", "China Middle"),
    "C": ("WEST NORTH",),
    "D": ("WEST SOUTH",),
}
OWN_PRODUCT = "自营商品"
THIRD_PARTY_PRODUCT = "第三方商品"


def area_clicks(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Each product click with the city and area it came from."""
    further = [c for c in clicks.columns if c not in ("city_id", "product_id")]
    return clicks.join(cities, "city_id").select("city_id", "city_name", "area", "product_id", *further)


def _label() -> Column:
    return concat_long_string(F.col("city_id"), F.col("city_name"))


def area_product_counts(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks and cities of each product in each area.

    Clicks are counted per city and product before anything else: a code-generated hash aggregation
    that leaves at most one row per city and product, so neither a hot product nor a hot city
    travels as single clicks, and the join sees counts only.
    """
    per_city = clicks.groupBy("city_id", "product_id").agg(F.count(F.lit(1)).alias("clicks"))
    return (
        per_city.join(cities, "city_id")
        .groupBy("area", "product_id")
        .agg(F.sum("clicks").alias("click_count"), join_sorted(F.collect_set(_label())).alias("city_infos"))
    )


def area_product_counts_direct(basic: DataFrame) -> DataFrame:
    """The same counts straight from :func:`area_clicks`."""
    return basic.groupBy("area", "product_id").agg(
        F.count(F.lit(1)).alias("click_count"), join_sorted(F.collect_set(_label())).alias("city_infos")
    )


def area_product_counts_salted(basic: DataFrame, buckets: int, row_key: Sequence[str]) -> DataFrame:
    """The same counts in two stages, with each group first split over ``buckets`` parts.

    The part of a row follows from ``row_key``, columns that tell the clicks of one group apart.
    """
    parts = (
        basic.withColumn("salt", salt(buckets, *row_key))
        .groupBy("area", "product_id", "salt")
        .agg(F.count(F.lit(1)).alias("clicks"), F.collect_set(_label()).alias("labels"))
    )
    return parts.groupBy("area", "product_id").agg(
        F.sum("clicks").alias("click_count"),
        join_sorted(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("city_infos"),
    )


def area_product_counts_hot_keys(
    basic: DataFrame, buckets: int, row_key: Sequence[str], share: float = 0.02
) -> DataFrame:
    """The same counts, where only products that hold at least ``share`` of all clicks are split over ``buckets`` parts.

    Which ones they are a sketch tells, see :func:`footfall.operators.skew.hot_keys`. The groups of all other products are counted
    in one stage and travel once.
    """
    hot = hot_keys(basic, "product_id", share)
    if not hot:
        return area_product_counts_direct(basic)
    split = F.col("product_id").isin(hot)
    cold = area_product_counts_direct(basic.where(~split))
    return cold.unionByName(area_product_counts_salted(basic.where(split), buckets, row_key))


def with_products(counts: DataFrame, products: DataFrame) -> DataFrame:
    """Add the name and the raw info of each product; unknown products fall out."""
    return counts.join(products, F.col("product_id") == F.col("id")).select(
        *counts.columns, "product_name", "info"
    )


def area_level(area: Column, levels: Mapping[str, Sequence[str]]) -> Column:
    label = F.lit(LEVEL_LABELS["E"])
    for level in ("D", "C", "B", "A"):
        areas = list(levels.get(level, ()))
        if areas:
            label = F.when(area.isin(areas), F.lit(LEVEL_LABELS[level])).otherwise(label)
    return label


def product_status(info: Column) -> Column:
    """Anything but an explicit 0 counts as third party, also missing or broken info."""
    own = json_field(info, "product_status").try_cast("int") == 0
    return F.when(own, F.lit(OWN_PRODUCT)).otherwise(F.lit(THIRD_PARTY_PRODUCT))


def top_products(
    counts: DataFrame,
    products: DataFrame,
    levels: Mapping[str, Sequence[str]] = DEFAULT_LEVELS,
    top: int = 3,
) -> DataFrame:
    """The ``top`` products of each area. Only they have their info parsed."""
    best = Window.partitionBy("area").orderBy(F.desc("click_count"), F.asc("product_id"))
    ranked = with_products(counts, products).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= top).select(
        "area",
        area_level(F.col("area"), levels).alias("area_level"),
        "product_id",
        "click_count",
        "city_infos",
        "product_name",
        product_status(F.col("info")).alias("product_status"),
    )
