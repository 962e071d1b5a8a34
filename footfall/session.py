"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that leave results alone but keep plans healthy on skewed or badly sized inputs.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot user or session may hold a large share of all rows. Splitting it is worth the extra
    # shuffle that the next aggregation then needs.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # All times in the tables are UTC.
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "footfall", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str, fallback: str | None = None) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    ``fallback`` is used only where the session names no shared folder, as in local tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not base:
        raise ValueError("spark.checkpoint.dir is not set and no fallback folder was given")
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


def local_fallback(spark: SparkSession) -> str | None:
    """A machine-local folder that may stand in for the shared one: for ``local[...]`` sessions only."""
    master = spark.sparkContext.master
    return tempfile.gettempdir() if master == "local" or master.startswith("local[") else None


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table and read it back: cut lineage that survives lost executors."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
