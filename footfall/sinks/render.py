"""Results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _collected(rates: DataFrame) -> DataFrame:
    """All steps of a flow in one row; a flow has as many steps as its parameter names."""
    steps = F.array_sort(F.collect_list(F.struct("step", "page_split", "convert_rate")))
    return rates.agg(steps.alias("steps"))


def packed_rates(rates: DataFrame) -> DataFrame:
    """``1_2=0.1|2_3=0.87`` in step order; a step without a rate has no value after ``=``."""
    text = F.transform(
        "steps",
        lambda s: F.concat(s["page_split"], F.lit("="), F.coalesce(s["convert_rate"].cast("string"), F.lit(""))),
    )
    return _collected(rates).select(F.array_join(text, "|").alias("convert_rate"))


def json_rates(rates: DataFrame) -> DataFrame:
    """A JSON array that holds one object from page pair to rate."""
    # A flow may name the same pair twice. Both carry the same rate only by chance: the last step wins.
    last = F.filter(
        "steps",
        lambda s: ~F.exists("steps", lambda t: (t["page_split"] == s["page_split"]) & (t["step"] > s["step"])),
    )
    pairs = F.map_from_entries(F.transform(last, lambda s: F.struct(s["page_split"], s["convert_rate"])))
    return _collected(rates).select(F.to_json(F.array(pairs)).alias("result"))
