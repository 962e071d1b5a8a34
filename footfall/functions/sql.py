"""Names for SQL users: temporary functions whose bodies are Spark's own functions.

A distinct concatenation needs no function of ours: ``listagg(DISTINCT c, ',') WITHIN GROUP (ORDER BY c)``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_DEFINITIONS = (
    "concat_long_string(number BIGINT, txt STRING, sep STRING) RETURNS STRING"
    " RETURN concat(CAST(number AS STRING), sep, txt)",
    "json_field(doc STRING, field STRING) RETURNS STRING"
    " RETURN get_json_object(doc, concat('$.', field))",
    # With a key the prefix is the same whenever a row is worked out again; without one it is drawn.
    "random_prefix(txt STRING, buckets INT, row_key STRING DEFAULT NULL) RETURNS STRING"
    " RETURN concat(CAST(CASE WHEN row_key IS NULL THEN CAST(floor(rand() * buckets) AS BIGINT)"
    " ELSE pmod(xxhash64(row_key), buckets) END AS STRING), '_', txt)",
    "remove_random_prefix(txt STRING) RETURNS STRING RETURN regexp_replace(txt, '^[0-9]+_', '')",
    "trim_comma(txt STRING) RETURNS STRING RETURN regexp_replace(txt, '^,|,$', '')",
)


def register(spark: SparkSession) -> None:
    for definition in _DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
