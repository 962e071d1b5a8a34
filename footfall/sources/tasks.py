"""Task records: what an analysis was asked to do, as JSON in a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.documents import json_struct
from footfall.functions.texts import split_ids
from footfall.params import TaskParams
from footfall.schemas import TASK_PARAM


def parse_task_params(tasks: DataFrame) -> DataFrame:
    """One row per task with its parameters as typed columns."""
    parsed = tasks.select("task_id", "task_name", json_struct(F.col("task_param"), TASK_PARAM).alias("p"))
    return parsed.select(
        "task_id",
        "task_name",
        F.col("p.startDate").alias("start_date"),
        F.col("p.endDate").alias("end_date"),
        F.col("p.startAge").try_cast("int").alias("start_age"),
        F.col("p.endAge").try_cast("int").alias("end_age"),
        F.split("p.professionals", ",").alias("professionals"),
        F.split("p.cities", ",").alias("cities"),
        F.col("p.sex").alias("sex"),
        F.split("p.keywords", ",").alias("keywords"),
        split_ids(F.col("p.categoryIds")).alias("category_ids"),
        split_ids(F.col("p.targetPageFlow")).alias("target_page_flow"),
        F.col("p.cycle").alias("cycle"),
    )


def load_task(tasks: DataFrame, task_id: int) -> TaskParams | None:
    """Parameters of one task, needed to build the plan; ``None`` if there is no such task."""
    row = tasks.where(F.col("task_id") == task_id).select("task_param").head()
    return TaskParams.from_json(row["task_param"]) if row is not None else None
