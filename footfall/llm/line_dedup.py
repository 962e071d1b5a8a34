"""Fuzzy line deduplication: MinHash signatures of character shingles, banding, exact verification, union-find."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.blocks import block_pairs
from footfall.llm.common import Scratch, body, bounded_batches
from footfall.llm.components import connected_components
from footfall.llm.meeting import shared_bands

SHINGLE_CHARS = 6  # even: shingles are hashed in pairs of characters
BANDS = 12
ROWS = 5
THRESHOLD = 0.8
BATCH_CHARS = 1 << 16  # small arrays stay in the processor's cache
FEW_LINES = 32  # bands of so many lines have their pairs listed, larger ones are compared in blocks
BLOCK_LINES = 500
BLOCK_CHARS = 500_000
SLICE_BITS = 1 << 14

_BINS = BANDS * ROWS
_EMPTY = np.uint32(0xFFFFFFFF)
# Odd multipliers of 64 bits that spread hashes.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def normalised(line: str) -> str:
    """What of a line counts: letters without case, runs of white space as one space."""
    low = line.lower()
    if low.isprintable() and "  " not in low:  # of white space, only the plain space is printable
        return low.strip(" ")
    return " ".join(low.split())


def line_id(line: str) -> int:
    """A signed 64-bit hash that stands for a normalised line."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return (x ^ (x >> np.uint64(29))) * _MIX[2]


def _probes() -> np.ndarray:
    """For each bin, the others in an order of its own: where an empty bin looks for a value."""
    random = np.random.default_rng(7)
    return np.array([random.permutation(_BINS) for _ in range(_BINS)])


_PROBES = _probes()


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash at each character of lines in a row, padded; which of them are shingles; and the padded lengths."""
    pad = "\0" * (SHINGLE_CHARS - 1)
    lengths = np.array([len(s) for s in lines], np.int64)
    codes = np.frombuffer(pad.join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - SHINGLE_CHARS + 1
    pairs = codes[:-1].astype(np.uint64)
    pairs *= _MIX[0]
    pairs += codes[1:]
    hashes = pairs[:n].copy()
    for k in range(2, SHINGLE_CHARS, 2):
        hashes *= _MIX[1]
        hashes += pairs[k : n + k]
    hashes ^= hashes >> np.uint64(29)
    hashes *= _MIX[2]
    hashes ^= hashes >> np.uint64(32)
    # A line's shingles begin at its first places, one at least; those that reach into the next line are left out.
    padded = lengths + len(pad)
    counts = np.maximum(1, lengths - len(pad))
    valid = np.repeat(np.tile([True, False], len(lines)), np.stack([counts, padded - counts], axis=1).ravel())[:n]
    return hashes, valid, padded


def signatures(lines: list[str]) -> np.ndarray:
    """The minimum hashes of each line's shingles, one for each of the bins that the hashes are dealt into.

    Every shingle is hashed once and falls into one bin. A bin without shingles takes the value of the first bin with
    some, in an order of its own, so two lines agree in a bin with a probability that is their Jaccard similarity. A line
    shorter than a shingle is one shingle.
    """
    hashes, valid, padded = _shingle_hashes(lines)
    values = np.where(valid, hashes.astype(np.uint32) & np.uint32(0xFFFFFFFE), _EMPTY)
    hashes >>= np.uint64(32)
    hashes *= np.uint64(_BINS)
    hashes >>= np.uint64(32)
    places = hashes.view(np.int64)
    places += np.repeat(np.arange(len(lines)) * _BINS, padded)[: len(places)]
    out = np.full(len(lines) * _BINS, _EMPTY, np.uint32)
    np.minimum.at(out, places, values)
    out = out.reshape(-1, _BINS)
    first = out.copy()
    for turn in range(_BINS):
        row, bin_ = np.nonzero(out == _EMPTY)
        if not len(row):
            break
        out[row, bin_] = first[row, _PROBES[bin_, turn]]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for row in range(ROWS):
        keys = _mixed(keys * _MIX[0] + signature[:, row::ROWS].astype(np.uint64) + np.uint64(1))
    return (keys + np.arange(BANDS, dtype=np.uint64) * _MIX[0]).view(np.int64)


def shingles(line: str) -> frozenset[str]:
    n = max(1, len(line) - SHINGLE_CHARS + 1)
    return frozenset(line[i : i + SHINGLE_CHARS] for i in range(n))


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def alike(xs: list[str], ys: list[str], threshold: float) -> np.ndarray:
    """Which pairs of lines have a Jaccard similarity of ``threshold`` or more.

    Shingles are compared by hashes of 44 bits, many pairs at once; where the result is near the threshold, the
    shingles themselves are.
    """
    rows = np.uint64(44)

    def keys(lines: list[str]) -> np.ndarray:
        hashes, valid, padded = _shingle_hashes(lines)
        owner = np.repeat(np.arange(len(lines), dtype=np.uint64) << rows, padded)[: len(hashes)]
        found = ((hashes >> np.uint64(20)) | owner)[valid]
        found.sort()
        return found[np.concatenate([[True], found[1:] != found[:-1]])]

    def counted(found: np.ndarray) -> np.ndarray:
        return np.bincount((found >> rows).astype(np.int64), minlength=len(xs))

    a, b = keys(xs), keys(ys)
    both = np.concatenate([a, b])
    both.sort()
    shared = counted(both[1:][both[1:] == both[:-1]])
    similar = shared / (counted(a) + counted(b) - shared)
    out = similar >= threshold
    for n in np.flatnonzero(np.abs(similar - threshold) < 0.02):
        out[n] = jaccard(shingles(xs[n]), shingles(ys[n])) >= threshold
    return out


def _batches_of(texts: list[str]):
    """Neighbouring texts with a bounded number of characters together, one at least."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, key``: rows of equal id and text have equal keys and count as one document."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", body()).alias("key"))


def occurrences(keyed: DataFrame) -> DataFrame:
    """Every line that is not blank: ``doc_id, key, line_no, line, bands, content``.

    ``line`` is the hash of the normalised line, ``content``. A line's bands are worked out at its first occurrence in a
    batch; at the others they are empty, and ``content`` is null.
    """

    def run(batches):
        for batch in batches:
            doc_ids, texts, keys = (c.to_pylist() for c in batch.columns)
            rows: list[tuple] = []
            contents: list[str | None] = []
            fresh: dict[str, int] = {}
            for doc_id, text, key in zip(doc_ids, texts, keys, strict=True):
                for number, raw in enumerate((text or "").split("\n")):
                    if line := normalised(raw):
                        new = line not in fresh
                        if new:
                            fresh[line] = line_id(line)
                        rows.append((doc_id, key, number, fresh[line], new))
                        contents.append(line if new else None)
            if not rows:
                continue
            parts = [bands(signatures(part)) for part in _batches_of(list(fresh))]
            values = np.concatenate(parts).ravel()
            new = np.array([r[4] for r in rows])
            offsets = np.concatenate([[0], np.cumsum(new * BANDS)])
            ids, own, numbers, lines, _ = zip(*rows, strict=True)
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(own), pa.array(numbers, pa.int32()), pa.array(lines), listed,
                 pa.array(contents, pa.string())],
                ["doc_id", "key", "line_no", "line", "bands", "content"],
            )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, key long, line_no int, line long, bands array<long>, content string")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose lines have exact Jaccard similarity of at least ``threshold``."""
    left = texts.select(F.col("line").alias("a"), F.col("content").alias("content_a"))
    right = texts.select(F.col("line").alias("b"), F.col("content").alias("content_b"))

    def run(batches):
        for batch in batches:
            a, b = (batch.column(n).to_numpy(zero_copy_only=False) for n in (0, 1))
            xs, ys = (batch.column(n).to_pylist() for n in (2, 3))
            ends, size = [0], 0
            for n, (x, y) in enumerate(zip(xs, ys, strict=True), 1):
                size += len(x) + len(y)
                if size >= BATCH_CHARS or n == len(xs):
                    ends.append(n)
                    size = 0
            found = [alike(xs[i:j], ys[i:j], threshold) for i, j in zip(ends, ends[1:], strict=False) if j > i]
            if found:
                keep = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "content_a", "content_b")
    return joined.mapInArrow(run, "a long, b long")


def block_links(contents: list[str], roots: np.ndarray, sides: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Places of lines of different roots that are alike, enough to connect all such; only pairs across two sides.

    Where all lines are on one side, all pairs are compared. Each line is a row of bits, one for each distinct shingle,
    and shared shingles are counted for one line against all others at once, some thousand shingles at a time.
    """
    numbers: dict[str, int] = {}
    sets = [np.array([numbers.setdefault(x, len(numbers)) for x in shingles(c)], np.int64) for c in contents]
    sizes = np.array([len(x) for x in sets])
    n = len(sets)
    shared = np.zeros((n, n), np.int32)
    owner, every = np.repeat(np.arange(n), sizes), np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner, every = owner[order], every[order]
    for first in range(0, len(numbers), SLICE_BITS):
        low, high = np.searchsorted(every, [first, first + SLICE_BITS])
        bits = np.zeros((n, SLICE_BITS), np.uint8)
        bits[owner[low:high], every[low:high] - first] = 1
        words = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(n - 1):
            shared[i, i + 1 :] += np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int32)
    across = len(np.unique(sides)) > 1
    root, found = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n - 1):
        total = sizes[i] + sizes[i + 1 :] - shared[i, i + 1 :]
        alike = (shared[i, i + 1 :] >= threshold * total) & (roots[i + 1 :] != roots[i])
        if across:
            alike &= sides[i + 1 :] != sides[i]
        for j in np.flatnonzero(alike) + i + 1:
            if find(i) != find(int(j)):
                root[find(i)] = find(int(j))
                found.append((i, int(j)))
    return found


def few_crossing(rest: DataFrame) -> DataFrame:
    """Pairs ``a, b`` to compare in bands of few lines: no more than a fixed number for each line. ``linked`` is false."""
    member = F.struct("line", "root")
    groups = rest.groupBy("band").agg(F.sort_array(F.collect_set(member)).alias("m"))
    one = groups.select("m", F.explode("m").alias("x"))
    others = F.filter("m", lambda y: (y["line"] > F.col("x.line")) & (y["root"] != F.col("x.root")))
    pairs = one.select(F.col("x.line").alias("a"), F.explode(others).alias("y"))
    return pairs.select("a", F.col("y.line").alias("b"), F.lit(False).alias("linked"))


def crossing_links(rest: DataFrame, texts: DataFrame, threshold: float, block: int = BLOCK_LINES) -> DataFrame:
    """Links ``a, b`` between lines that share a band but have different roots.

    A band's lines are dealt into blocks of a bounded number of lines and characters, and each pair of blocks is
    compared in a group of its own, which an exchange of its own spreads over tasks. So no group and no task grows with the
    band, and no pairs are listed but links.
    """
    lines = rest.select("band", "line", "root").join(texts, "line")
    dealt = block_pairs(lines, "line", "length(content)", block, BLOCK_CHARS)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        found = block_links(
            group["content"].tolist(), group["root"].to_numpy(), group["own"].to_numpy(), threshold
        )
        lines = group["line"].to_numpy()
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": lines[pairs[:, 0]], "b": lines[pairs[:, 1]]})

    return dealt.groupBy("band", "one", "two").applyInPandas(compare, "a long, b long").distinct()


def line_components(seen: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """Lines linked to others, with the smallest line of their component: ``node, root``.

    Lines that share a band are compared with the smallest line of the band first, or of the part of it that they came in, and
    what is linked is put together. Only where a band then still holds lines of several components are lines of different
    ones compared with each other, in blocks. So every pair of a band is linked, or linked over others, or compared; a group of many near copies costs one
    comparison a line, and no bands' pairs are listed.
    """
    banded = seen.filter("size(bands) > 0")
    members = scratch.table(shared_bands(banded, BANDS, seen.count()), "members")

    # Written out, so that its size is known where the join is planned: texts are shuffled only if they must be.
    wanted = scratch.table(members.select("line").distinct(), "wanted")
    texts = banded.select("line", "content").join(wanted, "line", "left_semi").distinct()
    texts = scratch.table(texts, "texts")
    stars = members.filter("line <> least").select(F.col("least").alias("a"), F.col("line").alias("b")).distinct()
    links = scratch.table(verified(stars, texts, threshold), "star-links")
    roots = connected_components(links, scratch)

    placed = members.join(roots, members.line == roots.node, "left").select(
        "band", "line", "least", "whole", F.coalesce("root", "line").alias("root")
    )
    placed = scratch.table(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s")
    mixed = scratch.table(mixed.select("band"), "mixed-bands")
    # The least line of a whole band has been compared with all others.
    rest = scratch.table(placed.join(mixed, "band", "left_semi").filter("line <> least OR NOT whole"), "rest")
    sizes = scratch.table(rest.groupBy("band").agg(F.count("*").alias("n")), "sizes")
    few = rest.join(sizes.filter(F.col("n") <= FEW_LINES).select("band"), "band", "left_semi")
    many = rest.join(sizes.filter(F.col("n") > FEW_LINES).select("band"), "band", "left_semi")
    crossing = few_crossing(few).unionByName(crossing_links(many, texts, threshold).withColumn("linked", F.lit(True)))
    crossing = scratch.table(crossing, "crossing")
    listed = verified(crossing.filter("not linked").select("a", "b").distinct(), texts, threshold)
    more = listed.unionByName(crossing.filter("linked").select("a", "b"))
    more = scratch.table(more, "cross-links")
    scratch.drop("sizes", "crossing", "members", "wanted", "texts", "placed", "mixed-bands", "rest")
    if more.isEmpty():
        return roots
    again = Scratch(seen.sparkSession, "line-dedup-again")
    return connected_components(links.unionByName(more), again)


def deduplicate_lines(docs: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep one line of each component of alike lines: ``doc_id, text, n_lines, n_kept``, one row per input row.

    Columns named in ``keep``, none of them a result column, follow unchanged.

    Lines are alike if the Jaccard similarity of their character shingles is at least ``threshold``, letters' case and
    amount of white space aside; components are connected over such links among all documents. The line that stays is
    the one in the document with the smallest ``doc_id``, the first there. ``text`` is what is left of the document,
    ``n_lines`` and ``n_kept`` count lines that are not blank. Blank lines stay, but for those of a text that loses
    all its lines, which becomes empty.

    A null text stays null. Rows with a null ``doc_id`` come after all others. Rows of equal id and text count as one
    document and get the same result; rows of equal id with other texts are documents of their own. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = bounded_batches(docs.sparkSession)
    scratch = Scratch(spark, "line-dedup")
    keyed = _keyed(docs)
    seen = scratch.table(occurrences(keyed), "occurrences")
    roots = line_components(seen, scratch, threshold)

    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "line_no")
    firsts = scratch.table(seen.groupBy("line").agg(F.min(place).alias("first")), "firsts")
    placed = firsts.join(roots, firsts.line == roots.node, "left").select(
        "line", "first", F.coalesce("root", "line").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first").alias("keeper"))
    keepers = scratch.table(placed.join(least, "root").select("line", "keeper.key", "keeper.line_no"), "keepers")
    keepers = keepers.select("line", F.col("key").alias("keep_key"), F.col("line_no").alias("keep_no"))

    judged = seen.select("key", "line_no", "line").join(keepers, "line")
    kept = F.when((F.col("key") == F.col("keep_key")) & (F.col("line_no") == F.col("keep_no")), F.col("line_no"))
    # A document's own line numbers: no more than it has lines.
    left = judged.groupBy("key").agg(F.collect_set(kept).alias("kept"))
    left = scratch.table(left, "left")

    def rebuild(batches):
        for batch in batches:
            ids, texts, kept_numbers, *others = batch.columns
            out, totals, counts = [], [], []
            for text, numbers in zip(texts.to_pylist(), kept_numbers.to_pylist(), strict=True):
                lines = (text or "").split("\n")
                filled = [bool(line.strip()) for line in lines]
                totals.append(sum(filled))
                counts.append(len(numbers or ()))
                if counts[-1] == totals[-1]:
                    out.append(text)
                elif not numbers:
                    out.append("")
                else:
                    stays = set(numbers)
                    out.append("\n".join(x for n, x in enumerate(lines) if n in stays or not filled[n]))
            columns = [ids, pa.array(out, pa.string()), pa.array(totals, pa.int64()), pa.array(counts, pa.int64()), *others]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_lines", "n_kept", *keep])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text, key = F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", body()).alias("key")
    own = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("own")] if keep else []
    whole = docs.select("doc_id", text, key, *own).join(left, "key", "left")
    whole = whole.select("doc_id", "text", "kept", *(["own.*"] if keep else []))
    others = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return whole.mapInArrow(rebuild, f"doc_id {kind}, text string, n_lines long, n_kept long{others}")
