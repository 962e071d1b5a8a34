"""Session analysis: histogram, sample, top categories and their top sessions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from footfall.operators import categories, histogram, sampling, scans, sessions
from footfall.params import TaskParams
from footfall.session import materialize, shared_folder
from footfall.sinks.tables import ROWS, TaskResults, rows_of

SAMPLE_SIZE = 1000
_DETAIL = (
    "user_id",
    "session_id",
    "page_id",
    "action_time",
    "search_keyword",
    "click_category_id",
    "click_product_id",
    "order_category_ids",
    "order_product_ids",
    "pay_category_ids",
    "pay_product_ids",
)


class Counted(NamedTuple):
    """What a run has read, kept and written. No job of its own counts it: it is observed while the results are made.

    ``written`` is exact, whatever tasks were run again. ``actions`` is observed before a shuffle: tasks run again
    because their shuffle files were lost with an executor count twice.
    """

    actions: int
    sessions: int
    written: dict[str, int]


def run_session_analysis(
    actions: DataFrame,
    users: DataFrame,
    params: TaskParams,
    task_id: int,
    out: str,
    *,
    sample_size: int = SAMPLE_SIZE,
    seed: str = "0",
    work: str | None = None,
) -> Counted:
    """Write all results of one task below ``out``; running the task again replaces them, all of them at its end.

    The matching sessions are worked out once and written, since every result needs them: one narrow
    row per session, where the actions behind them are wide and many. The small frames the details
    depend on are read back from their result tables rather than worked out again.
    """
    spark = actions.sparkSession
    scanned = scans.action_scan(actions, params.start_date, params.end_date)
    read, kept_rows, count = Observation(), Observation(), F.count(F.lit(1)).alias(ROWS)
    matching = sessions.matching_spans(scanned.observe(read, count), users, params).observe(kept_rows, count)
    spans = materialize(matching, shared_folder(spark, "matching-sessions", work))
    with TaskResults(spark, out, task_id) as results:
        _write_results(scanned, spans, results, sample_size, seed, work)
    return Counted(rows_of(read), rows_of(kept_rows), results.written)


def _write_results(
    scanned: DataFrame, spans: DataFrame, results: TaskResults, sample_size: int, seed: str, work: str | None
) -> None:
    spark, write = scanned.sparkSession, results.write
    write(histogram.session_histogram(spans), "session_aggr_stat")

    sample = sampling.session_sample(spans.select("session_id", "start_time"), sample_size, seed)
    sample = materialize(sample, shared_folder(spark, "session-sample", work))
    detail = categories.details_of(scanned, sample)
    write(sessions.session_lists(detail), "session_random_extract")
    write(detail.select(*_DETAIL), "session_detail")

    kept = sessions.rows_of(scanned, spans)
    top = write(categories.top_categories(categories.category_counts(kept)), "top10_category")
    # Few clicks fall on the top categories: counting them first leaves little to match to sessions.
    clicks = sessions.rows_of(categories.session_clicks(scanned, top), spans)
    best = write(categories.top_sessions(clicks), "top10_category_session")
    best_detail = categories.details_of(scanned, best)
    write(best_detail.select(*_DETAIL), "top10_session_detail")
