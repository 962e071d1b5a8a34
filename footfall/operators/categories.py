"""Categories by clicks, orders and payments, and the sessions most active in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.texts import split_ids

TOP = 10


def _ids(lists: DataFrame, *keep: str) -> DataFrame:
    """One row per id of the comma lists in ``ids``; parts that are no number are left out."""
    parts = lists.where("ids IS NOT NULL").select(*keep, F.explode(F.split("ids", ",")).alias("part"))
    numbers = parts.select(*keep, F.col("part").try_cast("bigint").alias("category_id"))
    return numbers.where(F.col("category_id").isNotNull())


def category_touches(actions: DataFrame) -> DataFrame:
    """One row per category an action clicks, orders or pays for.

    Clicked ids stay numbers; only lists that are there are split, and an action without any of the
    three makes no row.
    """

    def touched(kind: str, ids: Column) -> Column:
        return F.transform(ids, lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("category_id")))

    none = F.array().cast("array<bigint>")
    clicked = F.array_compact(F.array("click_category_id"))
    every = F.concat(
        touched("click", clicked),
        touched("order", F.coalesce(split_ids(F.col("order_category_ids")), none)),
        touched("pay", F.coalesce(split_ids(F.col("pay_category_ids")), none)),
    )
    some = F.coalesce(F.col("click_category_id").cast("string"), "order_category_ids", "pay_category_ids")
    return actions.where(some.isNotNull()).select(F.inline(every))


def category_counts(actions: DataFrame) -> DataFrame:
    """Clicks, orders and payments per category, in one pass and one aggregation.

    The three columns become rows side by side; only rows with a list are split. The parts of a list are read as numbers after
    that, so nothing is worked out by functions over arrays.
    """
    kinds = "stack(3, 'click', CAST(click_category_id AS STRING), 'order', order_category_ids, 'pay', pay_category_ids)"
    listed = actions.select(F.expr(f"{kinds} AS (kind, ids)")).where(F.col("ids").isNotNull())
    parts = listed.select("kind", F.explode(F.split("ids", ",")).alias("part"))
    touched = parts.select("kind", F.col("part").try_cast("bigint").alias("category_id"))
    kind = F.col("kind")
    return touched.where(F.col("category_id").isNotNull()).groupBy("category_id").agg(
        F.count_if(kind == "click").alias("click_count"),
        F.count_if(kind == "order").alias("order_count"),
        F.count_if(kind == "pay").alias("pay_count"),
    )


def clicks_per_category(actions: DataFrame) -> DataFrame:
    clicked = actions.where(F.col("click_category_id").isNotNull())
    return clicked.groupBy(F.col("click_category_id").alias("category_id")).agg(
        F.count(F.lit(1)).alias("click_count")
    )


def listed_per_category(actions: DataFrame, column: str, alias: str) -> DataFrame:
    """Occurrences of each category in a comma list column."""
    listed = _ids(actions.select(F.col(column).alias("ids")))
    return listed.groupBy("category_id").agg(F.count(F.lit(1)).alias(alias))


def category_counts_joined(actions: DataFrame) -> DataFrame:
    """The same counts as :func:`category_counts`, from three aggregations joined to all categories."""
    categories = category_touches(actions).select("category_id").distinct()
    joined = (
        categories.join(clicks_per_category(actions), "category_id", "left")
        .join(listed_per_category(actions, "order_category_ids", "order_count"), "category_id", "left")
        .join(listed_per_category(actions, "pay_category_ids", "pay_count"), "category_id", "left")
    )
    return joined.select(
        "category_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("click_count", "order_count", "pay_count")],
    )


def top_categories(counts: DataFrame, top: int = TOP) -> DataFrame:
    """By clicks, then orders, then payments; the smaller id where all three are equal."""
    order = [F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), F.asc("category_id")]
    return counts.orderBy(*order).limit(top)


def session_clicks(actions: DataFrame, categories: DataFrame) -> DataFrame:
    """Clicks per (category, session) for a choice of categories, such as the top ones.

    The join comes first and drops all other clicks. How is left to the sizes: the rows of a limit or
    a small table are broadcast by themselves, more are shuffled. Counting then shrinks each input
    partition to one row per category and session.
    """
    clicked = actions.where(F.col("click_category_id").isNotNull()).select(
        F.col("click_category_id").alias("category_id"), "session_id"
    )
    wanted = categories.select("category_id")
    return clicked.join(wanted, "category_id").groupBy("category_id", "session_id").agg(
        F.count(F.lit(1)).alias("click_count")
    )


def top_sessions(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The sessions with most clicks in each category; each map task passes on only its own best."""
    best = Window.partitionBy("category_id").orderBy(F.desc("click_count"), F.asc("session_id"))
    ranked = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("category_id", "session_id", "click_count")


def details_of(actions: DataFrame, few_sessions: DataFrame) -> DataFrame:
    """All actions of a choice of sessions, such as top sessions or a sample."""
    return actions.join(few_sessions.select("session_id"), "session_id", "left_semi").select(*actions.columns)
