"""Strings, comma lists and packed ``name=value|name=value`` records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def trim_comma(text: Column) -> Column:
    """Drop one comma from each end."""
    return F.regexp_replace(text, "^,|,$", "")


def two_digits(text: Column) -> Column:
    """Zero in front of anything that is not two characters long."""
    return F.when(F.length(text) == 2, text).otherwise(F.concat(F.lit("0"), text))


def concat_long_string(number: Column, text: Column, separator: str = ":") -> Column:
    return F.concat(number.cast("string"), F.lit(separator), text)


def split_ids(comma_list: Column) -> Column:
    """``"5,6,"`` to ``[5, 6]``: parts that are no number are left out."""
    numbers = F.transform(F.split(comma_list, ","), lambda part: part.try_cast("bigint"))
    return F.array_compact(numbers)


def join_sorted(values: Column) -> Column:
    """Array to a sorted comma string; NULL for an empty array."""
    texts = F.sort_array(values).cast("array<string>")
    return F.nullif(F.array_join(texts, ","), F.lit(""))


def get_field(packed: Column, field: str, separator: str = "|") -> Column:
    """Value of the first ``field=value`` part; NULL when missing or empty."""
    parts = F.filter(
        _parts(packed, separator),
        lambda p: (F.split_part(p, F.lit("="), F.lit(1)) == field) & (F.size(_filled(p)) == 2),
    )
    return F.get(_filled(F.get(parts, F.lit(0))), F.lit(1))


def set_field(packed: Column, field: str, value: Column, separator: str = "|") -> Column:
    """Replace the value of the first part named ``field``; other parts stay as they are.

    A NULL value leaves the field there, without a value.
    """
    parts = _parts(F.rtrim(packed, F.lit(separator)), separator)
    names = F.transform(parts, lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    hit = F.array_position(names, F.lit(field))
    replaced = F.transform(
        parts,
        lambda p, i: F.when(i + 1 == hit, F.concat(F.lit(field + "="), F.coalesce(value, F.lit("")))).otherwise(p),
    )
    return F.array_join(replaced, separator)


def _parts(packed: Column, separator: str) -> Column:
    return F.split(packed, "\\Q" + separator + "\\E")


def _filled(part: Column) -> Column:
    """The pieces of ``name=value`` without trailing empty ones."""
    return F.split(F.regexp_replace(part, "=+$", ""), "=")


def salt(buckets: int, *row_key: str) -> Column:
    """Bucket number from the row's own key: the same again when a lost task is run anew."""
    return F.pmod(F.xxhash64(*row_key), F.lit(buckets)).cast("int")
