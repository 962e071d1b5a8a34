"""Page flows: which page follows which, and how many visitors go on to the next page.

A session is cut into slices of time. Pages are paired inside each slice, and where one slice ends
the next slice of the same session goes on. The pairs are those of the whole session in order, but
no task has to sort a session that holds a large share of all actions: such a session is spread over
its slices, and only two rows per slice meet again. A slice with very many views, a burst, is cut
once more, by the second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.numbers import ratio

SLICE_MINUTES = 10
_SLICE = ("session_id", "slice", "second")
# A slice of which this many of one in ``SAMPLED`` views are found is cut by the second. Only the
# largest so many are; any other holds less than one in ``MAX_BURSTS`` of all views.
SAMPLED, BURST, MAX_BURSTS = 1024, 64, 10_000


def flow_pairs(flow: Sequence[int]) -> list[tuple[int, int]]:
    return list(zip(flow, flow[1:]))


def flow_steps(df: DataFrame, flow_text: str) -> DataFrame:
    """``"1,2,3"`` as rows (step, from_page, to_page)."""
    pages = F.split(F.lit(flow_text), ",")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(pages) - 1),
        lambda i: F.struct(
            i.alias("step"),
            F.trim(F.get(pages, i - 1)).cast("bigint").alias("from_page"),
            F.trim(F.get(pages, i)).cast("bigint").alias("to_page"),
        ),
    )
    return df.sparkSession.range(1).select(F.inline(F.when(F.size(pages) > 1, steps)))


def bursts(views: DataFrame, sampled: int = SAMPLED, burst: int = BURST) -> DataFrame:
    """The slices with very many views, counted on a sample: it decides how views are spread, not what comes out."""
    some = views.where(F.pmod(F.xxhash64("session_id", "action_time", "page_id"), F.lit(sampled)) == 0)
    counts = some.groupBy("session_id", "slice").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= burst)
    largest = counts.orderBy(F.desc("n"), "session_id", "slice").limit(MAX_BURSTS)
    return largest.select("session_id", "slice", F.lit(True).alias("burst"))


def _sliced(actions: DataFrame, minutes: int, sampled: int = SAMPLED, burst: int = BURST) -> DataFrame:
    """Page views with the next page inside the slice. One shuffle, by session and slice.

    Views of the same instant stay together: they are ordered by page.
    """
    kind = actions.schema["action_time"].dataType
    epoch = F.lit("1970-01-01 00:00:00").cast(kind)
    slice_no = F.floor(F.timestamp_diff("MINUTE", epoch, F.col("action_time")) / minutes)
    in_slice = Window.partitionBy(*_SLICE).orderBy("action_time", "page_id")
    views = actions.where(F.col("page_id").isNotNull()).select(
        "session_id", slice_no.alias("slice"), "action_time", "page_id"
    )
    second = F.when(F.col("burst"), F.timestamp_diff("SECOND", epoch, F.col("action_time"))).otherwise(F.lit(0))
    views = views.join(F.broadcast(bursts(views, sampled, burst)), ["session_id", "slice"], "left")
    views = views.select("session_id", "slice", second.alias("second"), "action_time", "page_id")
    return views.withColumns(
        {
            "next_page": F.lead("page_id").over(in_slice),
            "position": F.row_number().over(in_slice),
        }
    )


def _slice_ends() -> list[Column]:
    return [
        F.max(F.when(F.col("position") == 1, F.col("page_id"))).alias("first_page"),
        F.max(F.when(F.col("next_page").isNull(), F.col("page_id"))).alias("last_page"),
    ]


def _next_slice_page() -> Column:
    return F.lead("first_page").over(Window.partitionBy("session_id").orderBy("slice", "second"))


def page_pairs(
    actions: DataFrame, slice_minutes: int = SLICE_MINUTES, sampled: int = SAMPLED, burst: int = BURST
) -> DataFrame:
    """Every step from one page to the next inside a session, as rows."""
    sliced = _sliced(actions, slice_minutes, sampled, burst)
    inside = sliced.where(F.col("next_page").isNotNull()).select(
        "session_id", F.col("page_id").alias("from_page"), F.col("next_page").alias("to_page")
    )
    ends = sliced.groupBy(*_SLICE).agg(*_slice_ends())
    across = ends.select(
        "session_id", F.col("last_page").alias("from_page"), _next_slice_page().alias("to_page")
    ).where(F.col("to_page").isNotNull())
    return inside.unionByName(across)


def match_flow(pairs: DataFrame, flow: Sequence[int]) -> DataFrame:
    """The pairs that are part of a flow."""
    wanted = flow_steps(pairs, ",".join(str(p) for p in flow)).select("from_page", "to_page").distinct()
    return pairs.join(F.broadcast(wanted), ["from_page", "to_page"], "left_semi").select(*pairs.columns)


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("from_page", "to_page").agg(F.count(F.lit(1)).alias("pv"))


def start_page_views(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    return actions.where(F.col("page_id") == flow[0]).agg(F.count(F.lit(1)).alias("pv"))


def flow_conversion(actions: DataFrame, flow: Sequence[int], slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """Conversion of each step of a flow against the step before it.

    All steps and the views of the first page are counted in one pass: per slice, then over the
    seams between slices, then in total. A pair that never occurs counts 0; a rate over 0 is NULL.
    """
    pairs = flow_pairs(flow)
    per_slice = _sliced(actions, slice_minutes).groupBy(*_SLICE).agg(
        *_slice_ends(),
        F.count_if(F.col("page_id") == flow[0]).alias("start_pv"),
        *[
            F.count_if((F.col("page_id") == a) & (F.col("next_page") == b)).alias(f"inside_{i}")
            for i, (a, b) in enumerate(pairs)
        ],
    )
    joined = per_slice.withColumn("next_slice_page", _next_slice_page())
    total = joined.agg(
        F.coalesce(F.sum("start_pv"), F.lit(0)).alias("pv_0"),
        *[
            (
                F.coalesce(F.sum(f"inside_{i}"), F.lit(0))
                + F.count_if((F.col("last_page") == a) & (F.col("next_slice_page") == b))
            ).alias(f"pv_{i + 1}")
            for i, (a, b) in enumerate(pairs)
        ],
    )
    steps = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(f"{a}_{b}").alias("page_split"),
                F.col(f"pv_{i + 1}").alias("pv"),
                F.col(f"pv_{i}").alias("prev_pv"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    rated = total.select(F.inline(steps))
    return rated.withColumn("convert_rate", ratio(F.col("pv"), F.col("prev_pv")))
