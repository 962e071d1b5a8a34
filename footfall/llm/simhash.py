"""Near duplicates by SimHash: fingerprints that differ in few bits, found by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import Scratch, body, bounded_batches, map_batches
from footfall.llm.components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
PASSES = 4
VARIANTS_PER_TASK = 2_000_000
PRINTS_PER_TASK = 4096

# An odd multiplier and its inverse modulo 2**64. Multiplying spreads variants evenly over the buckets.
SPREAD = 0x9E3779B97F4A7C15
GATHER = pow(SPREAD, -1, 1 << 64)


def simhash(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text: the majority of its shingles' hash bits, repeats included."""
    parts = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces only
    if not parts:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(parts) - words + 1)
    votes = np.zeros(64, np.int64)
    for first in range(0, n, 16384):
        hashes = [digest(join(parts[i : i + words]), SEED) for i in range(first, min(n, first + 16384))]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` of every row, the fingerprint as a signed 64-bit integer. Null texts count as empty: zero."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([simhash(x.as_buffer().to_pybytes(), words) for x in batch.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", body().alias("body")), run, f"doc_id {key}, fp long")


def ball(radius: int) -> np.ndarray:
    """All 64-bit masks with at most ``radius`` bits set."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return np.array(masks, np.uint64)


def _links_in_bucket(keys: np.ndarray, flips: np.ndarray, masks: np.ndarray, radius: int) -> np.ndarray:
    """Links between the fingerprints that share a variant, as rows (a, b).

    Fingerprints around one variant are within the radius of each other, so linking each to the smallest of them loses
    no component, and no pairs of a group are listed.
    """
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.concatenate([[True], keys[1:] != keys[:-1]])
    shared = ~start | np.concatenate([~start[1:], [False]])
    run = np.cumsum(start)[shared]
    if not len(run):
        return np.empty((0, 2), np.int64)
    prints = ((keys[shared] * np.uint64(GATHER)) ^ masks[flips[order][shared]]).view(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    least = np.repeat(np.minimum.reduceat(prints, heads), np.diff(np.append(heads, len(run))))
    pairs = np.stack([least, prints], axis=1)[least != prints]
    # Verified: the bits in which the two differ.
    far = np.bitwise_count((pairs[:, 0] ^ pairs[:, 1]).view(np.uint64)) > radius
    return np.unique(pairs[~far], axis=0)


def links(prints: DataFrame, count: int, scratch: Scratch, radius: int = RADIUS, passes: int = PASSES) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``), enough to connect all within ``radius`` bits.

    Every fingerprint emits all variants that differ from it in at most half the radius; two fingerprints within the
    radius meet in at least one. Variants are spread evenly over buckets by a bijective multiplication and travel as
    packed arrays, ten bytes each. The buckets are worked off in ``passes`` rounds, which bounds the disk in use;
    their number follows ``count``, so a task's memory does not.
    """
    if radius % 2 or passes & (passes - 1) or passes < 2:
        raise ValueError("the radius must be even and the passes a power of two")
    prints = prints.select("fp").repartition(1 + count // PRINTS_PER_TASK, "fp")
    masks = ball(radius // 2)
    bits = max(3, int(count * len(masks) / passes / VARIANTS_PER_TASK).bit_length())
    buckets = 1 << bits
    high = np.uint64(65 - passes.bit_length())
    shift = high - np.uint64(bits)

    def emit_pass(turn: int):
        def emit(batches):
            for batch in batches:
                every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for first in range(0, len(every), 1024):
                    variants = every[first : first + 1024, None] ^ masks[None, :]
                    keys = (variants * np.uint64(SPREAD)).ravel()
                    # The highest bits choose the pass, the next ones the bucket.
                    chosen = np.flatnonzero(keys >> high == np.uint64(turn))
                    keys = keys[chosen]
                    order = np.argsort(keys)
                    keys, flips = keys[order], (chosen[order] % len(masks)).astype("<u2")
                    bounds = np.arange(turn * buckets, (turn + 1) * buckets, dtype=np.uint64)
                    ends = np.searchsorted(keys >> shift, bounds, side="right")
                    starts = np.concatenate([[0], ends[:-1]])
                    full = np.flatnonzero(ends > starts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full.astype(np.int32)),
                            pa.array([keys[starts[i] : ends[i]].tobytes() for i in full], pa.binary()),
                            pa.array([flips[starts[i] : ends[i]].tobytes() for i in full], pa.binary()),
                        ],
                        ["bucket", "keys", "flips"],
                    )

        return emit

    def meet(batches):
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for bucket, keys, flips in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(bucket, []).append((keys, flips))
        for bucket in list(held):
            keys, flips = zip(*held.pop(bucket), strict=True)
            found = _links_in_bucket(
                np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(flips), "<u2"), masks, radius
            )
            for first in range(0, len(found), 100_000):
                part = found[first : first + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["a", "b"])

    found = None
    for turn in range(passes):
        sent = prints.mapInArrow(emit_pass(turn), "bucket int, keys binary, flips binary")
        met = sent.repartition(buckets, "bucket").mapInArrow(meet, "a long, b long")
        part = scratch.table(met, f"met-{turn}")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Group documents whose fingerprints are linked: ``doc_id, fingerprint, component_id``, one row per input row.

    ``component_id`` is the smallest ``doc_id`` that can be reached over links, the document itself included. A text
    without words (empty or null too) has fingerprint zero and is linked like any other. Repeated rows are repeated. A
    null ``doc_id`` keeps its row and is never a ``component_id`` unless its whole component has null ids. Texts of
    any length are hashed piece by piece. Other columns are ignored. An empty table gives an empty result.
    """
    spark = bounded_batches(docs.sparkSession)
    scratch = Scratch(spark, "simhash")
    every = scratch.table(fingerprints(docs, words), "prints")
    distinct = scratch.table(every.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = links(distinct, distinct.count(), scratch, radius)
    roots = connected_components(found, scratch)
    scratch.drop(*(f"met-{turn}" for turn in range(PASSES)))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = scratch.table(placed.join(least, "root").select("fp", "component_id"), "named")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return every.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each group the document with the smallest ``doc_id``.

    Rows of one id stay or go together, but of rows that agree in id and text one stays. A group without ids stays as
    one row per text.
    """
    stay = near_duplicates(docs, words).filter("doc_id <=> component_id").select(F.col("doc_id").alias("stays")).distinct()
    kept = docs.join(stay, F.expr("doc_id <=> stays"), "left_semi")
    return kept.withColumn("same text", F.xxhash64(body())).dropDuplicates(["doc_id", "same text"]).select(docs.columns)
