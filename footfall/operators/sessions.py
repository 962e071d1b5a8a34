"""Actions rolled up to sessions, and sessions filtered by user and behaviour."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.texts import join_sorted
from footfall.functions.times import seconds_between
from footfall.params import TaskParams

_USER_COLUMNS = ("user_id", "age", "professional", "city", "sex")
_ROLLUP_COLUMNS = (
    "session_id",
    "user_id",
    "search_keywords",
    "click_category_ids",
    "visit_length",
    "step_length",
    "start_time",
    "age",
    "professional",
    "city",
    "sex",
)


def _word() -> Column:
    return F.when(F.col("search_keyword") != "", F.col("search_keyword"))


def session_rollup(actions: DataFrame, users: DataFrame) -> DataFrame:
    """Every session with its user, distinct words and categories, length in seconds, and steps.

    One pass: each input partition is reduced to one row per session before the shuffle. The user is
    that of the earliest action, the smaller id where two act in the same instant. Sessions of
    unknown users fall out.
    """
    rolled = actions.groupBy("session_id").agg(
        F.min(F.struct("action_time", "user_id")).alias("first"),
        F.max("action_time").alias("end_time"),
        F.count(F.lit(1)).alias("step_length"),
        F.collect_set(_word()).alias("words"),
        F.collect_set("click_category_id").alias("categories"),
    )
    sessions = rolled.select(
        "session_id",
        F.col("first.user_id").alias("user_id"),
        join_sorted(F.col("words")).alias("search_keywords"),
        join_sorted(F.col("categories")).alias("click_category_ids"),
        seconds_between(F.col("end_time"), F.col("first.action_time")).alias("visit_length"),
        "step_length",
        F.col("first.action_time").alias("start_time"),
    )
    return with_users(sessions, users).select(*_ROLLUP_COLUMNS)


def with_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    return sessions.join(users.select(*_USER_COLUMNS), "user_id")


def user_conditions(params: TaskParams) -> Column:
    """Age range (only with both ends), profession, city and sex; what is not given passes."""
    conditions = []
    if params.start_age is not None and params.end_age is not None:
        conditions.append(F.col("age").between(params.start_age, params.end_age))
    if params.professionals is not None:
        conditions.append(F.col("professional").isin(list(params.professionals)))
    if params.cities is not None:
        conditions.append(F.col("city").isin(list(params.cities)))
    if params.sex is not None:
        conditions.append(F.col("sex") == params.sex)
    return functools.reduce(operator.and_, conditions, F.lit(True))


def _shares_item(comma_list: Column, wanted: Sequence[object]) -> Column:
    items = F.array(*[F.lit(str(w)) for w in wanted])
    return F.arrays_overlap(F.split(comma_list, ","), items)


def list_conditions(params: TaskParams) -> Column:
    """At least one of the wanted words, and at least one of the wanted categories."""
    conditions = []
    if params.keywords is not None:
        conditions.append(_shares_item(F.col("search_keywords"), params.keywords))
    if params.category_ids is not None:
        conditions.append(_shares_item(F.col("click_category_ids"), params.category_ids))
    return functools.reduce(operator.and_, conditions, F.lit(True))


def filter_sessions(rollup: DataFrame, params: TaskParams) -> DataFrame:
    return rollup.where(user_conditions(params) & list_conditions(params))


def matching_spans(actions: DataFrame, users: DataFrame, params: TaskParams) -> DataFrame:
    """The sessions :func:`filter_sessions` keeps, with their spans but without their lists.

    Counting and sampling need no lists. The first level groups by session and user over fixed-width
    state alone, so it runs as a code-generated hash aggregation that shrinks each input partition
    before the shuffle: a session that holds a third of all actions reaches its reducer as one row
    per map task. The second level sees about one row per session.
    """
    per_user = actions.groupBy("session_id", "user_id").agg(
        F.min("action_time").alias("start_time"),
        F.max("action_time").alias("end_time"),
        F.count(F.lit(1)).alias("step_length"),
        _any_row(_word_wanted(params)).alias("word_hit"),
        _any_row(_category_wanted(params)).alias("category_hit"),
    )
    spans = (
        per_user.groupBy("session_id")
        .agg(
            F.min(F.struct("start_time", "user_id")).alias("first"),
            F.max("end_time").alias("end_time"),
            F.sum("step_length").alias("step_length"),
            F.bool_or("word_hit").alias("word_hit"),
            F.bool_or("category_hit").alias("category_hit"),
        )
        .where(F.col("word_hit") & F.col("category_hit"))
        .select(
            "session_id",
            F.col("first.user_id").alias("user_id"),
            F.col("first.start_time").alias("start_time"),
            seconds_between(F.col("end_time"), F.col("first.start_time")).alias("visit_length"),
            "step_length",
        )
    )
    return with_users(spans, users).where(user_conditions(params))


def _any_row(condition: Column | None) -> Column:
    return F.lit(True) if condition is None else F.coalesce(F.bool_or(condition), F.lit(False))


def _word_wanted(params: TaskParams) -> Column | None:
    if params.keywords is None:
        return None
    word = F.col("search_keyword")
    # The split is for words that hold commas themselves; all others are settled by the set lookup.
    return word.isin(list(params.keywords)) | (word.contains(",") & _shares_item(word, params.keywords))


def _category_wanted(params: TaskParams) -> Column | None:
    if params.category_ids is None:
        return None
    return F.col("click_category_id").isin(list(params.category_ids))


def session_lists(actions: DataFrame) -> DataFrame:
    """Start and lists of the sessions that some actions belong to, for a small choice of sessions."""
    return actions.groupBy("session_id").agg(
        F.min("action_time").alias("start_time"),
        join_sorted(F.collect_set(_word())).alias("search_keywords"),
        join_sorted(F.collect_set("click_category_id")).alias("click_category_ids"),
    )


def rows_of(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """The rows, such as actions or counts, of some sessions; nothing of the sessions is added."""
    return rows.join(sessions.select("session_id"), "session_id", "left_semi").select(*rows.columns)
