"""Comparing the members of large groups with each other in blocks, none of which grows with its group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(members: DataFrame, node: str, weight: str, rows: int, most: int) -> DataFrame:
    """Rows of ``members(band, ...)`` once for each pair of blocks of their band that they belong to: ``one, two``.

    A band is dealt by the hash of ``node`` into blocks of about ``rows`` rows and ``most`` of the expression ``weight``. The
    pairs of one band are spread over tasks: their number grows with the square of the band's size, and the joins before
    leave all rows of a band in one task.
    """
    sums = members.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.expr(weight)).alias("weight"))
    blocks = F.ceil(F.greatest(F.col("n") / rows, F.col("weight") / most)).cast("int").alias("blocks")
    own = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    with_own = members.join(sums.select("band", blocks), "band").withColumn("own", own)
    dealt = with_own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
    return dealt.repartition("band", "one", "two")
