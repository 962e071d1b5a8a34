"""Hard negatives by an inverted multi-index: exact search over cells of two half-space codebooks.

A vector is cut into halves; each half belongs to the nearest word of a codebook of its own, and the two words name a cell.
The inner product of a query half with anything at a word is at most that with the word plus the query half's length
times the word's radius, so the sum of two such bounds holds for a cell. A multi-sequence heap visits the cells of a
query by falling bounds and stops once no cell left can change the result. What is found is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.common import Scratch, bounded_batches

SCALE = 256
CODEWORDS = 32
SAMPLE_ROWS = 4096  # codebooks are fitted on so many vectors; every vector is indexed
FIT_ROUNDS = 8
BLOCK_ROWS = 4096
CHUNK_ANCHORS = 256
FIRST_ROWS = 1024  # cells of so many vectors are visited before anything is known about an anchor


@dataclass(frozen=True)
class Index:
    """What a search needs besides the vectors: its size follows the codebooks, not the rows."""

    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray  # vectors by cell
    first: np.ndarray  # first block of a cell
    pieces: np.ndarray  # blocks of a cell

    def visits(self, query: np.ndarray) -> Iterator[tuple[float, int]]:
        """Cells that hold vectors, with their bounds, by falling bounds."""
        half = self.words[0].shape[1]
        order, bounds = [], []
        for part, words, radii in zip((query[:half], query[half:]), self.words, self.radii, strict=True):
            bound = words @ part + np.linalg.norm(part) * radii
            order.append(np.argsort(-bound, kind="stable"))
            bounds.append(bound[order[-1]].tolist())
        (left, right), (u, v) = order, bounds
        heap, width = [(-(u[0] + v[0]), 0, 0)], len(right)
        while heap:
            bound, a, b = heapq.heappop(heap)
            cell = int(left[a]) * width + int(right[b])
            if self.counts[cell]:
                yield -bound, cell
            if b + 1 < width:
                heapq.heappush(heap, (-(u[a] + v[b + 1]), a, b + 1))
            if b == 0 and a + 1 < len(left):
                heapq.heappush(heap, (-(u[a + 1] + v[0]), a + 1, 0))

    def blocks(self, query: np.ndarray, least: float | None) -> list[int]:
        """Blocks to search: at first those of the best cells; then, given the least score that matters, the rest of them."""
        seen, rows, opened, more = set(), 0, False, set()
        slack = 1 + 1e-9 * float(np.abs(query).sum()) * float(max(np.abs(w).max(initial=0) for w in self.words))
        for bound, cell in self.visits(query):
            opened = opened or rows >= FIRST_ROWS
            if opened and (least is None or bound + slack < least):
                break
            (more if opened else seen).update(range(self.first[cell], self.first[cell] + self.pieces[cell]))
            rows += int(self.counts[cell])
        return sorted(seen) if least is None else sorted(more - seen)


def vectors(embeddings: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """``vec_id, label, v`` of the rows that take part, and the number of components.

    A component x becomes floor(scale * x), in 32 bits; larger ones raise an error. Rows with a null id, label or vector, or
    with a null or non-finite component take no part. Of rows of one id the one with the least label, then vector, counts.
    Shorter vectors are filled up with zeros.
    """
    whole = F.col("embedding").cast("array<double>")
    sound = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    named = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole.isNotNull() & sound)
    rows = named.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), whole.alias("x"))).alias("r"))
    dims = named.agg(F.max(F.size(whole))).head()[0] or 0

    def quantise(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            listed = batch.column(2)
            sizes = np.diff(listed.offsets.to_numpy())
            values = np.floor(scale * listed.flatten().to_numpy(zero_copy_only=False))
            if len(values) and np.abs(values).max() > 2**31 - 1:
                raise ValueError("a component is too large to be scored in integers")
            out = np.zeros((batch.num_rows, dims), "<i4")
            out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = values
            packed = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["vec_id", "label", "v"])

    picked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "r.label", "r.x")
    return picked.mapInArrow(quantise, "vec_id long, label long, v binary"), dims


def _fit(points: np.ndarray, count: int) -> np.ndarray:
    """Centres of a sample, by a few rounds of k-means from its first distinct points."""
    _, first = np.unique(points, axis=0, return_index=True)
    centres = points[np.sort(first)[:count]].astype(float)
    for _ in range(FIT_ROUNDS):
        near = _nearest(points, centres)[0]
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = points[near == k].mean(axis=0)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T
    near = apart.argmin(axis=1)
    return near, np.linalg.norm(points - centres[near], axis=1)


def _unpack(packed, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), dims)


def build_index(rows: DataFrame, dims: int, scratch: Scratch, codewords: int = CODEWORDS) -> tuple[DataFrame, Index]:
    """``vec_id, label, v, block`` of every row, dealt into blocks of bounded size by cell, and the index over them.

    A cell of many vectors, such as copies of one, takes several blocks; small ones share a block with their neighbours.
    """
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()
    sample = _unpack([r.v for r in drawn], dims).astype(float)
    half = dims // 2
    words = tuple(_fit(part, codewords) for part in (sample[:, :half], sample[:, half:]))
    width = len(words[1])

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _unpack([x.as_py() for x in batch.column(2)], dims).astype(float)
            (i, far_i), (j, far_j) = _nearest(points[:, :half], words[0]), _nearest(points[:, half:], words[1])
            added = [pa.array(x) for x in ((i * width + j).astype(np.int32), far_i, far_j)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], ["vec_id", "label", "v", "cell", "far_i", "far_j"])

    placed = rows.mapInArrow(assign, "vec_id long, label long, v binary, cell int, far_i double, far_j double")
    placed = scratch.table(placed, "placed")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far_i").alias("i"), F.max("far_j").alias("j"))
    counts = np.zeros(len(words[0]) * width, np.int64)
    radii = np.zeros(len(words[0])), np.zeros(width)
    for cell, n, far_i, far_j in cells.collect():  # one row a cell: codewords squared at most
        counts[cell] = n
        radii[0][cell // width] = max(radii[0][cell // width], far_i)
        radii[1][cell % width] = max(radii[1][cell % width], far_j)
    pieces = np.maximum(1, -(-counts // BLOCK_ROWS))
    first, at, held = np.zeros(len(counts), np.int64), -1, BLOCK_ROWS
    for cell in np.flatnonzero(counts).tolist():
        if held + counts[cell] > BLOCK_ROWS:
            at, held = at + 1, 0
        first[cell] = at
        held += counts[cell]
        at += int(pieces[cell]) - 1
    placing = F.array(*(F.lit(int(x)) for x in first)), F.array(*(F.lit(int(x)) for x in pieces))
    cell = F.col("cell")
    piece = F.pmod(F.xxhash64("vec_id"), F.get(placing[1], cell).cast("long"))
    dealt = placed.select("vec_id", "label", "v", (F.get(placing[0], cell) + piece).cast("long").alias("block"))
    return scratch.table(dealt, "dealt"), Index(words, radii, counts, first, pieces)


def _route(anchors: DataFrame, index: Index, dims: int, chunks: int, rest: bool, scratch: Scratch, name: str) -> DataFrame:
    """A row for each anchor and block that it has to look at. ``least`` is the least score that still matters."""
    kinds = {f.name: f.dataType.simpleString() for f in anchors.schema}
    names = list(kinds)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            queries = _unpack([x.as_py() for x in batch.column("v")], dims).astype(float)
            least = batch.column("least").to_pylist() if rest else [None] * len(queries)
            lists = [index.blocks(q, x) for q, x in zip(queries, least, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], [*names, "blocks"])

    routed = anchors.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", blocks array<long>")
    chunk = F.pmod(F.xxhash64("anchor_id"), F.lit(chunks)).alias("chunk")
    return scratch.table(routed.select(*names, F.explode("blocks").alias("block"), chunk), name)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: exact in doubles below 2^53, otherwise by whole numbers of any size."""
    most = int(np.abs(anchors.astype(np.int64)).max(initial=0)) * int(np.abs(rows.astype(np.int64)).max(initial=0))
    if most * rows.shape[1] < 2**53:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    exact = anchors.astype(object) @ rows.astype(object).T
    return exact.astype(np.int64)  # raises where a score does not fit


def _best(scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the highest scores, equal ones in the order they stand in."""
    if len(scores) > 4 * count:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
        return among[np.argsort(-scores[among], kind="stable")[:count]]
    return np.argsort(-scores, kind="stable")[:count]


def _search(routed: DataFrame, dealt: DataFrame, find, schema: str) -> DataFrame:
    """Apply ``find(anchors, rows)`` to every chunk of anchors and block of rows that meet, each in a group of bounded size."""
    meeting = routed.select(F.col("block").alias("block"), F.col("chunk").alias("chunk")).distinct()
    copies = dealt.join(meeting, "block").repartition("block", "chunk")  # not by block alone, as the join leaves them
    left = routed.repartition("block", "chunk").groupBy("block", "chunk")
    return left.cogroup(copies.groupBy("block", "chunk")).applyInPandas(find, schema)


def _ranked(found: DataFrame, keys: list[str], count: int, score: str, tie: str) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= count)


def positives(anchors: DataFrame, dealt: DataFrame, index: Index, dims: int, chunks: int, count: int, scratch: Scratch) -> DataFrame:
    """The best rows of each anchor's own label: ``anchor_id, positive_id, positive_score, rank``."""

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("vec_id", kind="stable")
        ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
        scores = _scores(_unpack(left["v"], dims), _unpack(right["v"], dims)) if len(left) and len(right) else None
        out = []
        for n, (anchor, label) in enumerate(zip(left["anchor_id"], left["label"], strict=True)):
            if scores is not None:
                same = np.flatnonzero((labels == label) & (ids != anchor))
                best = same[_best(scores[n][same], count)]
                out.append((np.full(len(best), anchor), ids[best], scores[n][best]))
        return _frame(out, ["anchor_id", "positive_id", "positive_score"])

    schema = "anchor_id long, positive_id long, positive_score long"
    rank = (["anchor_id"], count, "positive_score", "positive_id")
    seen = _search(_route(anchors, index, dims, chunks, False, scratch, "near-routes"), dealt, find, schema)
    seen = scratch.table(_ranked(seen, *rank), "first-positives")
    floor = seen.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.min("positive_score").alias("worst"))
    least = F.when(F.col("n") >= count, F.col("worst").cast("double")).otherwise(F.lit(float("-inf")))
    known = anchors.join(floor, "anchor_id", "left").select(*anchors.columns, least.alias("least"))
    more = _search(_route(known, index, dims, chunks, True, scratch, "far-routes"), dealt, find, schema)
    return scratch.table(_ranked(seen.drop("rank").unionByName(more), *rank), "positives")


def negatives(windows: DataFrame, dealt: DataFrame, index: Index, dims: int, chunks: int, count: int, scratch: Scratch) -> DataFrame:
    """The best rows of other labels inside each window of scores: ``anchor_id, positive_id, negative_id, negative_score, rank``.

    ``windows`` has an anchor's windows as ``windows array<struct<positive_id, low, high>>``.
    """

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("vec_id", kind="stable")
        ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
        scores = _scores(_unpack(left["v"], dims), _unpack(right["v"], dims)) if len(left) and len(right) else None
        out = []
        for n, (anchor, label, spans) in enumerate(zip(left["anchor_id"], left["label"], left["windows"], strict=True)):
            if scores is None:
                continue
            other = np.flatnonzero(labels != label)
            order = other[np.argsort(-scores[n][other], kind="stable")]
            falling = -scores[n][order]
            for span in spans:
                start, end = np.searchsorted(falling, -span["high"], "left"), np.searchsorted(falling, -span["low"], "right")
                best = order[start : min(end, start + count)]
                positive = np.full(len(best), span["positive_id"])
                out.append((np.full(len(best), anchor), positive, ids[best], scores[n][best]))
        return _frame(out, ["anchor_id", "positive_id", "negative_id", "negative_score"])

    schema = "anchor_id long, positive_id long, negative_id long, negative_score long"
    keys = ["anchor_id", "positive_id"]
    rank = (keys, count, "negative_score", "negative_id")
    seen = _search(_route(windows, index, dims, chunks, False, scratch, "near-windows"), dealt, find, schema)
    seen = scratch.table(_ranked(seen, *rank), "first-negatives")
    # A window is certified down to its last find once it is full, and down to its low end before.
    spans = windows.select("anchor_id", F.explode("windows").alias("w")).select("anchor_id", "w.positive_id", "w.low")
    floor = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("negative_score").alias("worst"))
    least = F.when(F.col("n") >= count, F.col("worst")).otherwise(F.col("low")).cast("double")
    open_from = spans.join(floor, keys, "left").groupBy("anchor_id").agg(F.min(least).alias("least"))
    known = windows.join(open_from, "anchor_id")
    more = _search(_route(known, index, dims, chunks, True, scratch, "far-windows"), dealt, find, schema)
    return _ranked(seen.drop("rank").unionByName(more), *rank)


def _frame(parts: list[tuple[np.ndarray, ...]], columns: list[str]) -> pd.DataFrame:
    joined = [np.concatenate(x) if parts else np.empty(0) for x in (zip(*parts, strict=True) if parts else [()] * len(columns))]
    return pd.DataFrame({c: x.astype(np.int64) for c, x in zip(columns, joined, strict=True)})


def mine(
    embeddings: DataFrame,
    every: int = 50,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    codewords: int = CODEWORDS,
) -> DataFrame:
    """Hard negatives of the rows of ``embeddings(vec_id, label, embedding)`` whose id is divisible by ``every``.

    A score is the integer inner product with the anchor. An anchor's positives are the ``n_positives`` best other rows of
    its label; of each positive, the ``n_negatives`` best rows of other labels whose scores are from ``low`` to ``high`` percent
    of the positive's are returned: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Ties go to
    the smaller id. All results are exact whatever the codebooks are like; those decide how much is looked at.

    For rows that take no part and repeated ids see :func:`vectors`. Other columns are ignored. An empty table, or one without
    anchors, gives an empty result.
    """
    scratch = Scratch(bounded_batches(embeddings.sparkSession), "negatives")
    rows, dims = vectors(embeddings)
    rows = scratch.table(rows, "vectors")
    if rows.isEmpty():
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return embeddings.sparkSession.createDataFrame([], schema)
    dealt, index = build_index(rows, dims, scratch, codewords)
    anchors = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "v")
    chunks = 1 + anchors.count() // CHUNK_ANCHORS
    best = positives(anchors, dealt, index, dims, chunks, n_positives, scratch)
    span = F.struct(
        "positive_id",
        F.expr(f"-floor(-{low} * positive_score / 100.0BD)").cast("long").alias("low"),
        F.expr(f"floor({high} * positive_score / 100.0BD)").cast("long").alias("high"),
    )
    spans = best.select("anchor_id", span.alias("w")).filter("w.low <= w.high")
    windows = anchors.join(spans.groupBy("anchor_id").agg(F.collect_list("w").alias("windows")), "anchor_id")
    found = negatives(scratch.table(windows, "windows"), dealt, index, dims, chunks, n_negatives, scratch)
    scored = found.join(best.drop("rank"), ["anchor_id", "positive_id"])
    return scored.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
