"""JSON held in string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_field(text: Column, field: str) -> Column:
    """One field as a string; NULL for bad JSON or a missing field."""
    return F.get_json_object(text, f"$.{field}")


def json_struct(text: Column, schema: T.StructType) -> Column:
    return F.from_json(text, schema)


def json_strings(text: Column) -> Column:
    """A JSON array of strings."""
    return F.from_json(text, T.ArrayType(T.StringType()))
