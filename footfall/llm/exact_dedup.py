"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import Scratch, body

PREFIX_CHARS = 256


def exact_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """Which row of each group of identical texts stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` with one row per input row. Of equal texts the row with
    the largest ``doc_id`` stays. Only texts that share byte length and prefix hash with another row are hashed as a
    whole; the others are alone in their group and have a null ``text_sha256`` unless ``digest_all`` asks for it.

    A null text counts as empty. A null ``doc_id`` ranks below all others. Of repeated rows (equal id and text) exactly
    one is kept. Other columns are ignored, whatever their names. An empty table gives an empty result.

    Counts are combined before every shuffle. The join that finds the texts to hash and the join that hands out the
    kept ids are plain equi-joins with nothing above that needs a key's rows together, so a key holding a third of
    all rows is split by adaptive execution.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = docs.select(F.col("doc_id"), body().alias("body"))
    n_bytes = F.octet_length("body").alias("n_bytes")
    prefix_hash = F.xxhash64(F.substring("body", 1, prefix_chars)).alias("prefix_hash")

    prefixes = text.select(n_bytes, prefix_hash).groupBy("n_bytes", "prefix_hash").agg(F.count("*").alias("n"))
    prefixes = scratch.table(prefixes, "prefixes")
    lengths = prefixes.groupBy("n_bytes").agg(F.sum("n").alias("in_length")).filter("in_length > 1")
    shared = (
        prefixes.filter("n > 1")
        .join(lengths.select("n_bytes"), "n_bytes", "left_semi")
        .select("n_bytes", "prefix_hash", F.lit(True).alias("shared"))
    )

    full = F.sha2(F.col("body").cast("binary"), 256)
    # Where all digests are asked for, they travel instead of the texts.
    carried = full.alias("digest") if digest_all else F.col("body")
    rows = (
        text.select("doc_id", carried, n_bytes, prefix_hash)
        .join(shared, ["n_bytes", "prefix_hash"], "left")
        .select(
            "doc_id",
            "n_bytes",
            F.coalesce("shared", F.lit(False)).alias("shared"),
            (F.col("digest") if digest_all else F.when(F.col("shared"), full)).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    rows = scratch.table(rows, "rows")

    alone = rows.filter("not shared").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    members = rows.filter("shared")
    groups = members.groupBy("n_bytes", "text_sha256").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")
    )
    groups = scratch.table(groups, "groups")  # so that the join has two plain exchanges, which can be split
    together = members.join(groups, ["n_bytes", "text_sha256"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(together)
