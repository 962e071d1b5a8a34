"""Passages that repeat across documents, found by anchors at the positions of a difference cover.

Two equal runs of words may start anywhere, but for any two starts there is a shift, less than the period, that takes both
to positions of the cover. So runs of ``window`` words share an aligned anchor of ``window - period + 1`` words at such a
shift, and only anchors at cover positions, four in thirteen, need to be hashed and compared between documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import Scratch, body, bounded_batches

WINDOW = 20
# A perfect difference set, each difference modulo 13 occurs.
PERIOD, COVER = 13, (0, 1, 3, 9)
# Odd multipliers of 64 bits that spread hashes.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def word_hashes(parts: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.uint64).reshape(-1, 2)


def run_hashes(words: np.ndarray, length: int, starts: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``length`` words from each start, of one column of word hashes."""
    out = np.full(len(starts), length, np.uint64)
    for k in range(length):
        out *= _MIX[seed]
        out += words[starts + k]
    return out


def cover_starts(n_words: int, length: int) -> np.ndarray:
    """Positions of the cover from which ``length`` words are left."""
    last = n_words - length
    if last < 0:
        return np.empty(0, np.int64)
    every = (np.arange(last // PERIOD + 1)[:, None] * PERIOD + np.array(COVER)).ravel()
    return every[every <= last]


def candidate_starts(n_words: int, places: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold a shared anchor, given as places in :func:`cover_starts`."""
    at = cover_starts(n_words, window - PERIOD + 1)[np.sort(places)]
    n = n_words - window + 1
    if n <= 0 or not len(at):
        return np.empty(0, np.int64)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(change, np.minimum(at + 1, n), -1)
    return np.flatnonzero(np.cumsum(change[:n]) > 0)


def _words(value) -> list[bytes]:
    return value.as_buffer().to_pybytes().split()


def _listed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), kind))


def _anchored(keyed: DataFrame, window: int) -> DataFrame:
    """``doc_id, key, d, e, n_words, anchors``: a hash of the anchor at each position of the cover."""
    length = window - PERIOD + 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, anchors = [], []
            for value in batch.column(4):
                parts = _words(value)
                starts = cover_starts(len(parts), length)
                counts.append(len(parts))
                anchors.append(run_hashes(word_hashes(parts)[:, 0], length, starts).view(np.int64))
            out = [*batch.columns[:4], pa.array(counts, pa.int64()), _listed(anchors, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "key", "d", "e", "n_words", "anchors"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    texts = keyed.select("doc_id", "key", "d", "e", "body")
    return texts.mapInArrow(run, f"doc_id {kind}, key long, d long, e long, n_words long, anchors array<long>")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """``key, starts, x, y, again``: the windows that hold a shared anchor, with two hashes of their words each.

    Of equal windows in a text the first is listed so; the others are only named by their starts, in ``again``.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found, x, y, again = [], [], [], []
            for value, places in zip(batch.column(1), batch.column(2), strict=True):
                parts = _words(value)
                starts = candidate_starts(len(parts), places.values.to_numpy(), window)
                hashes = word_hashes(parts)
                one, two = run_hashes(hashes[:, 0], window, starts), run_hashes(hashes[:, 1], window, starts, 1)
                order = np.lexsort((starts, two, one))
                new = np.ones(len(starts), bool)
                new[order[1:]] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
                found.append(starts[new].astype(np.int32))
                x.append(one[new].view(np.int64))
                y.append(two[new].view(np.int64))
                again.append(starts[~new].astype(np.int32))
            lists = [(found, pa.int32()), (x, pa.int64()), (y, pa.int64()), (again, pa.int32())]
            out = [batch.column(0), *(_listed(*x) for x in lists)]
            yield pa.RecordBatch.from_arrays(out, ["key", "starts", "x", "y", "again"])

    schema = "key long, starts array<int>, x array<long>, y array<long>, again array<int>"
    return texts.select("key", "body", "places").mapInArrow(run, schema)


def _order() -> Column:
    """Earlier documents have smaller ids; null ids come last. Rows of equal id and text are one document."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")


def repeated_windows(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """``key, starts, copy``: of each document, the windows that also start earlier. A ``copy`` of an earlier text is repeated whole."""
    keyed = docs.select("doc_id", body().alias("body"), F.xxhash64("doc_id", body()).alias("key"))
    keyed = keyed.withColumns({"d": F.xxhash64("body"), "e": F.xxhash64(F.lit("text"), "body")})
    every = scratch.table(_anchored(keyed, window), "anchored")
    one = every.select(_order().alias("own"), "key", "d", "e")
    firsts = one.groupBy("d", "e").agg(F.min("own").alias("first"), F.max("own").alias("last"))
    doubled = scratch.table(firsts.filter("first <> last").select("d", "e", "first"), "copied-texts")
    copies = one.join(doubled, ["d", "e"]).filter("own.key <> first.key").select("key").distinct()
    copies = scratch.table(copies, "copies")

    # A text counts once, by its first document; anchors that occur twice, in one text or in two, are shared.
    unique = every.join(copies, "key", "left_anti").filter(F.size("anchors") > 0).select("key", "doc_id", "anchors")
    unique = scratch.table(unique.dropDuplicates(["key"]), "unique")
    placed = unique.select("key", F.posexplode("anchors").alias("place", "anchor"))
    shared = placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    shared = scratch.table(shared, "shared")
    hits = placed.join(shared, "anchor").groupBy("key").agg(F.collect_list("place").alias("places"))
    hits = scratch.table(hits, "hits")
    # Documents are numbered in their order, so the earliest is a minimum over numbers.
    order = [F.col("doc_id").isNull(), "doc_id", "key"]
    sorted_ids = unique.select("doc_id", "key").repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = scratch.table(sorted_ids.select("key", F.monotonically_increasing_id().alias("no")), "numbers")
    scratch.drop("anchored", "shared", "unique")
    texts = keyed.select("key", "body").join(hits, "key").dropDuplicates(["key"])
    windows = scratch.table(_windows(texts, window).join(numbers, "key"), "windows")
    scratch.drop("hits", "numbers")

    each = windows.select("no", F.explode(F.arrays_zip("starts", "x", "y")).alias("w"))
    each = each.select("no", F.col("w.starts").alias("start"), F.col("w.x").alias("x"), F.col("w.y").alias("y"))
    first = each.groupBy("x", "y").agg(F.min("no").alias("first"), F.max("no").alias("last"))
    first = scratch.table(first.filter("first <> last").select("x", "y", "first"), "first")
    later = each.join(first, ["x", "y"]).filter("no <> first").groupBy("no").agg(F.collect_list("start").alias("later"))
    none = F.array().cast("array<int>")
    starts = windows.join(later, "no", "left").select("key", F.concat("again", F.coalesce("later", none)).alias("starts"))
    starts = starts.filter(F.size("starts") > 0).withColumn("copy", F.lit(False))
    whole = copies.select("key", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy"))
    found = scratch.table(starts.unionByName(whole), "repeated")
    scratch.drop("windows", "first", "copies", "copied-texts")
    return found


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the words of passages that earlier ones hold: ``doc_id, n_words, n_removed, text``.

    Words are cut at the six ASCII spaces and otherwise left as they are; ``text`` is the words that stay, joined by one
    space. A window is ``window`` words in a row of one document. A word goes if a window over it also starts earlier, in a
    document of smaller id or further ahead in its own; the first occurrence stays. All windows are judged on the
    documents as given. ``window`` is at least the period of the cover.

    Null texts count as empty. A null id comes after all others. Rows of one id with different texts are different
    documents, in the order of their hashes; rows that agree in both are one document and all treated alike. Other columns
    are ignored. An empty table gives an empty result.
    """
    if window < PERIOD:
        raise ValueError("the window must be at least as long as the period of the cover")
    scratch = Scratch(bounded_batches(docs.sparkSession), "passages")
    found = repeated_windows(docs, window, scratch)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", body().alias("body"), F.xxhash64("doc_id", body()).alias("key"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, removed, texts = [], [], []
            for value, starts, copy in zip(*batch.columns[1:], strict=True):
                parts = _words(value)
                counts.append(len(parts))
                stays = np.ones(len(parts), bool)
                if copy.as_py():
                    stays[:] = len(parts) < window
                elif starts.is_valid:
                    change = np.zeros(len(parts) + 1, np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    stays = np.cumsum(change[:-1]) == 0
                left = parts if stays.all() else [parts[n] for n in np.flatnonzero(stays)]
                removed.append(len(parts) - len(left))
                texts.append(b" ".join(left))
            out = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["doc_id", "n_words", "n_removed", "text"])

    joined = keyed.join(found, "key", "left").select("doc_id", "body", "starts", "copy")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, text string")


def kept_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the SHA-256 of what :func:`remove_repeats` leaves."""
    left = remove_repeats(docs, window)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))

