"""Page flow conversion."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from footfall.operators import funnel, scans
from footfall.params import TaskParams
from footfall.session import materialize, shared_folder
from footfall.sinks import render
from footfall.sinks.tables import replace_task


def run_page_flow(
    actions: DataFrame, params: TaskParams, task_id: int, out: str, *, work: str | None = None
) -> DataFrame:
    """Write the packed rates of one task and return them as a JSON text in one row."""
    if params.target_page_flow is None or len(params.target_page_flow) < 2:
        raise ValueError("a page flow of two pages or more is needed")
    scanned = scans.action_scan(actions, params.start_date, params.end_date)
    rates = materialize(
        funnel.flow_conversion(scanned, params.target_page_flow),
        shared_folder(actions.sparkSession, "page-flow", work),
    )
    replace_task(render.packed_rates(rates), task_id, os.path.join(out, "page_split_convert_rate"))
    return render.json_rates(rates)
