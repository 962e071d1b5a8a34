"""JSON lines with a fixed schema; malformed lines go to a quarantine frame."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.times import parse_time_ntz
from footfall.schemas import USER_ACTION_LOG_JSON, USER_BASE_INFO_JSON

CORRUPT = "_corrupt_record"


class Checked(NamedTuple):
    rows: DataFrame
    quarantine: DataFrame


def parse_lines(
    lines: DataFrame, schema: T.StructType, column: str = "value", times: tuple[str, ...] = ()
) -> Checked:
    """Parse one JSON object per row of ``lines``; the fields named in ``times`` become timestamps.

    A line that does not parse, or holds a time that can't be read, is kept whole in the quarantine;
    so is a NULL line. Blank lines are no records and are left out.
    """
    guarded = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    line = F.col(column)
    filled = lines.where(line.isNull() | (F.trim(line) != ""))
    # Generated, not just selected: the checks below would otherwise parse each line again.
    record = F.struct(line.alias("line"), F.from_json(line, guarded, options).alias("record"))
    parsed = filled.select(F.inline(F.array(record)))
    values = [F.col(f"record.{f.name}").alias(f.name) for f in schema.fields]
    texts = parsed.select("line", F.col(f"record.{CORRUPT}").alias(CORRUPT), *values)
    typed = texts.select(
        "line",
        *[parse_time_ntz(F.col(f.name)).alias(f.name) if f.name in times else F.col(f.name) for f in schema.fields],
        _damaged(times).alias(CORRUPT),
    )
    return Checked(
        typed.where(~F.col(CORRUPT)).drop("line", CORRUPT),
        typed.where(F.col(CORRUPT)).select("line"),
    )


def _damaged(times: tuple[str, ...]) -> Column:
    damaged = F.col("line").isNull() | F.col(CORRUPT).isNotNull()
    for name in times:
        damaged |= F.col(name).isNotNull() & parse_time_ntz(F.col(name)).isNull()
    return damaged


def read_json_lines(
    spark: SparkSession, path: str, schema: T.StructType, times: tuple[str, ...] = ()
) -> Checked:
    return parse_lines(spark.read.text(path), schema, times=times)


def user_base(lines: DataFrame) -> Checked:
    """Users from JSON lines."""
    return parse_lines(lines, USER_BASE_INFO_JSON, times=("registTime",))


def action_log(lines: DataFrame) -> Checked:
    """The action log from JSON lines."""
    return parse_lines(lines, USER_ACTION_LOG_JSON, times=("actionTime",))
