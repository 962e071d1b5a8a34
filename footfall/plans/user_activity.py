"""User activity: six rankings over one log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from footfall.functions.times import cycle_periods
from footfall.operators import activity
from footfall.params import TaskParams
from footfall.sinks.tables import TaskResults


def user_activity(
    log: DataFrame, users: DataFrame, params: TaskParams, as_of: dt.datetime
) -> dict[str, DataFrame]:
    """The rankings by name. Growth compares the running cycle with the one before it."""
    if params.start_date is None or params.end_date is None:
        raise ValueError("user activity needs a start and an end date")
    period = (params.start_date, params.end_date)
    current, previous = cycle_periods(as_of, params.cycle or "month")
    return {
        "top_visits": activity.top_visits(log, users, period),
        "top_spend": activity.top_spend(log, users, period),
        "visit_growth": activity.visit_growth(log, users, current, previous),
        "spend_growth": activity.spend_growth(log, users, current, previous),
        "first_days_visits": activity.first_days_visits(log, users, period),
        "first_days_spend": activity.first_days_spend(log, users, period),
    }


def run_user_activity(
    log: DataFrame, users: DataFrame, params: TaskParams, task_id: int, out: str, *, as_of: dt.datetime
) -> None:
    with TaskResults(log.sparkSession, out, task_id) as results:
        for name, ranking in user_activity(log, users, params, as_of).items():
            results.write(ranking, name)
