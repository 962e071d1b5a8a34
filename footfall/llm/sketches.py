"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is retained.

Sketches of parts merge by set union, and their sizes follow the texts, so containment can be estimated between texts
of very unequal length. Everything here is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import Scratch, body

SHINGLE_WORDS = 5
SCALE = 8  # one hash in eight is retained


def _bound(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """The sorted distinct retained shingle hashes of a text, ``array<bigint>``.

    Words are runs of non-space characters, lower-cased. A text with fewer words than a shingle is one shingle; a text
    without words has an empty sketch.
    """
    parts = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != F.lit(""))
    hashes = F.transform(parts, lambda w: F.xxhash64(w))
    largest = F.lit(-(1 << 63) + (1 << 64) // scale - 1)

    def shingles(h: Column) -> Column:
        n = F.size(h)
        several = F.transform(
            F.sequence(F.lit(0), n - F.lit(words)),
            lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(words)]),
        )
        whole = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
        none = F.array().cast("array<bigint>")
        return F.when(n >= words, several).when(n > 0, whole).otherwise(none)

    return F.array_sort(F.array_distinct(F.filter(_bound(hashes, shingles), lambda h: h <= largest)))


def merge(left: Column, right: Column) -> Column:
    """The sketch of two texts taken together (shingles across their seam apart)."""
    return F.array_sort(F.array_union(left, right))


def containment(inner: Column, outer: Column) -> Column:
    """The share of ``inner`` that ``outer`` contains, estimated from sketches; 0 where nothing was retained."""
    n = F.size(inner)
    return F.when(n > 0, F.size(F.array_intersect(inner, outer)) / n).otherwise(F.lit(0.0))


def encode(value: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash, in ascending order."""
    return F.concat_ws("", F.transform(value, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def successors(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Each distinct ``doc_id`` with the next larger one as ``next_id``; the last is followed by the first.

    A null id counts as the smallest. Only ids are moved: they are dealt into ranges, each range finds the successors
    inside itself, and one row per range closes the seams.
    """
    ids = docs.select("doc_id").distinct().repartitionByRange("doc_id")
    ids = scratch.table(ids.withColumn("part", F.spark_partition_id()), "ids")
    # One row per range partition, whose number is a setting: small on one task and as a broadcast.
    heads = ids.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("head"))
    seams = heads.selectExpr(
        "part",
        "coalesce(lead(head) OVER (ORDER BY part), first(head) OVER (ORDER BY part)).doc_id AS after",
    )
    ordered = ids.selectExpr(
        "part", "doc_id", "lead(struct(doc_id)) OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST) AS following"
    )
    next_id = F.when(F.col("following").isNull(), F.col("after")).otherwise(F.col("following.doc_id"))
    return ordered.join(F.broadcast(seams), "part").select("doc_id", next_id.alias("next_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, sketch`` of every row. Null texts count as empty; repeated rows are repeated."""
    return docs.select("doc_id", F.char_length(body()).alias("n_chars"), sketch(body()).alias("sketch"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited form, whose last quarter is the start of the next document.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Likeness is the
    containment of the document's sketch in the other one; equal texts have likeness 1 even where nothing is retained.

    Null texts count as empty, a null id as the smallest. Rows of one id follow each other in no order, so the next
    document is that of the next larger id; if that id is repeated, the one whose start and sketch come first counts.
    Every input row has one result row. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "sketches")
    texts = docs.select(
        "doc_id", body().alias("body"), sketch(body()).alias("sketch"), F.xxhash64(body()).alias("same")
    )
    quarter = F.floor(F.char_length(body()) / 4).cast("int")
    longest = docs.select(F.col("doc_id").alias("owner"), quarter.alias("quarter"))
    longest = longest.groupBy("owner").agg(F.max("quarter").alias("quarter"))
    following = successors(docs, scratch).join(longest, F.expr("doc_id <=> owner")).select("owner", "next_id", "quarter")
    starts = (
        texts.join(following, F.expr("doc_id <=> next_id"))
        .select("owner", F.expr("left(body, quarter)").alias("start"), "sketch", "same")
        .groupBy("owner")
        .agg(F.min(F.struct("start", "sketch", "same")).alias("next"))
    )
    n_chars = F.char_length("body")
    edited = F.concat(
        F.expr("left(body, char_length(body) - floor(char_length(body) / 4))"),
        F.expr("left(next.start, floor(char_length(body) / 4))"),
    )
    pairs = texts.join(starts, F.expr("doc_id <=> owner")).select(
        "doc_id",
        n_chars.alias("n_chars"),
        F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
        "sketch",
        sketch(edited).alias("edited_sketch"),
        F.col("next.sketch").alias("next_sketch"),
        (edited == F.col("body")).alias("unchanged"),
        (F.col("same") == F.col("next.same")).alias("repeated"),
    )

    def likeness(same: str, other: str) -> Column:
        return F.when(F.col(same), F.lit(1.0)).otherwise(containment(F.col("sketch"), F.col(other)))

    return pairs.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        encode(F.col("sketch")).alias("fingerprint"),
        encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness("unchanged", "edited_sketch").alias("near_edited"),
        likeness("repeated", "next_sketch").alias("near_next"),
    )
