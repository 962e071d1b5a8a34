"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Stripes are read in parallel, and a lookup of some documents reads only the stripes and row groups whose statistics and
Bloom filters admit them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.bpe import TextEncoder
from footfall.llm.common import body, bounded_batches, map_batches, worker_value

BATCH_IDS = 1 << 20
STRIPE_BYTES = 32 << 20
INDEX_STRIDE = 1000


def encode_sorted(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """The ids of every text with ``end_id`` behind, in ascending ``doc_id`` order over all partitions.

    Columns: ``doc_id, part, start_in_part, ids``. The texts are dealt into ranges of ``doc_id`` and sorted inside
    them; the encoder then runs over sorted partitions, so ids are never shuffled. Nulls sort first.
    """
    bounded_batches(docs.sparkSession)
    ordered = docs.select("doc_id", body().alias("body")).repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("body"))

    def run(batches):
        encoder: TextEncoder = worker_value(("library", path), lambda: TextEncoder(path, backtracking=False))
        end = np.array([end_id], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0

        def packed(keys: list, texts: list[bytes]) -> pa.RecordBatch:
            nonlocal at
            ids = np.frombuffer(b"".join(texts), "<u4").astype(np.int32)
            ends = np.cumsum([len(t) // 4 for t in texts])
            starts = np.concatenate([[0], ends[:-1]])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]), pa.int32()), pa.array(ids))
            columns = [
                pa.array(keys, key_type),
                pa.array(np.full(len(keys), part, np.int32)),
                pa.array(at + starts, pa.int64()),
                lists,
            ]
            at += int(ends[-1])
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start_in_part", "ids"])

        for batch in batches:
            key_type, keys, texts, size = batch.schema.field(0).type, [], [], 0
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                texts.append(encoder.encode(raw.as_buffer().to_pybytes()) + end)
                size += len(texts[-1]) // 4
                if size >= BATCH_IDS:
                    yield packed(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield packed(keys, texts)

    key = docs.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"doc_id {key}, part int, start_in_part long, ids array<int>")


def write_ids(encoded: DataFrame, folder: str) -> None:
    """Write encoded texts as ORC, keeping their order. Integer columns are run-length encoded by the format."""
    (
        encoded.write.format("orc")
        .option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .mode("errorifexists")
        .save(folder)
    )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The written table. Filters on ``doc_id`` are pushed into the files."""
    return spark.read.format("orc").load(folder)


def token_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document's ids lie in the whole sequence: ``doc_id, start, n_tokens, ids_crc32``, read from files.

    A part's ids follow those of all parts before it. Only the parts' totals, one row each, are added up in one place.
    """
    bounded_batches(spark)
    stored = read_ids(spark, folder)
    ends = stored.groupBy("part").agg(F.max(F.col("start_in_part") + F.size("ids")).alias("total"))
    before = ends.selectExpr(
        "part", "coalesce(sum(total) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before"
    )
    key = stored.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(3)
        ids, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        sums = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        columns = [*batch.columns[:3], pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    sums = map_batches(
        stored.select("doc_id", "part", "start_in_part", "ids"),
        run,
        f"doc_id {key}, part int, start_in_part long, n_tokens long, ids_crc32 long",
    )
    # One row per written part: small.
    return sums.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def store_and_locate(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Encode texts, write them to ``folder`` and locate each document in what was written.

    Null texts count as empty and hold the end id only. Null ids come first. Repeated rows are stored as often as they
    occur; rows of one id are in the order of a hash of their text. Other columns are ignored. An empty table gives an
    empty folder and result.
    """
    write_ids(encode_sorted(docs, path, end_id), folder)
    return token_positions(docs.sparkSession, folder)
