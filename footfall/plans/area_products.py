"""Top products per area."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from footfall.operators import products, scans
from footfall.params import TaskParams
from footfall.sinks.tables import replace_task


def run_area_products(
    actions: DataFrame,
    cities: DataFrame,
    product_info: DataFrame,
    params: TaskParams,
    task_id: int,
    out: str,
    *,
    levels: Mapping[str, Sequence[str]] = products.DEFAULT_LEVELS,
) -> None:
    clicks = scans.click_scan(actions, params.start_date, params.end_date)
    counts = products.area_product_counts(clicks, cities)
    top = products.top_products(counts, product_info, levels)
    replace_task(top, task_id, os.path.join(out, "area_top3_product"))
