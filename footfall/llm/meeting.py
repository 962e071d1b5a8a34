"""Which members of a table share a band, found by one shuffle of packed arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ENTRIES_PER_TASK = 1 << 20
FLUSH_ENTRIES = 1 << 20  # gathered by a task before they are packed
POOL_ENTRIES = 2 << 20  # held by a meeting task before it gives out what has met
CROWD = 32  # members of one band among those gathered from which on they are put together before the shuffle
_OUT_ROWS = 100_000

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # band, member, late


def settle(entries: Entries, last: bool) -> tuple[Entries, list[np.ndarray]]:
    """What to hold on to of some entries, and rows ``band, line, least, whole`` of the bands with several members.

    An entry is late if it has been given out as the least of a part of its band. Of a band with several members the least
    is held on to, late from then on. A band is whole if all its members were seen together.
    """
    band, member, late = entries
    order = np.argsort(band, kind="stable")
    same = band[order][1:] == band[order][:-1]
    several = np.zeros(len(band), bool)
    several[1:] |= same
    several[:-1] |= same
    alone, order = order[~several], order[several]
    order = order[np.lexsort((member[order], band[order]))]
    bands, members, lates = band[order], member[order], late[order]
    if len(order):
        heads = np.flatnonzero(np.concatenate([[True], (bands[1:] != bands[:-1]) | (members[1:] != members[:-1])]))
        bands, members, lates = bands[heads], members[heads], np.logical_or.reduceat(lates, heads)
    heads = np.flatnonzero(np.concatenate([[True], bands[1:] != bands[:-1]])) if len(bands) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(bands)))
    parted = np.logical_or.reduceat(lates, heads) if len(heads) else np.zeros(0, bool)
    shared = np.repeat(sizes > 1, sizes)
    rows = [
        bands[shared],
        members[shared],
        np.repeat(members[heads], sizes)[shared],
        np.repeat(~parted & last, sizes)[shared],
    ]
    held = (
        np.concatenate([band[alone], bands[heads]]),
        np.concatenate([member[alone], members[heads]]),
        np.concatenate([late[alone], parted | (sizes > 1)]),
    )
    return held, rows


def _packed(bucket: np.ndarray, columns: list[np.ndarray], apart: bool) -> pa.RecordBatch:
    """A row for each bucket: the entries' columns as bytes, the fourth one null or the least member."""
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    columns = [c[order] for c in columns]
    cut = [pa.array([c[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for c in columns]
    cut.insert(3 if not apart else 2, pa.nulls(len(names), pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *cut], ["bucket", "bands", "lines", "late", "leasts"])


def shared_bands(
    seen: DataFrame,
    n_bands: int,
    rows: int,
    per_task: int = ENTRIES_PER_TASK,
    flush: int = FLUSH_ENTRIES,
    crowd: int = CROWD,
    most_held: int = POOL_ENTRIES,
) -> DataFrame:
    """The members of bands that several lines have: ``band, line, least, whole``.

    ``seen(line, bands)`` has ``n_bands`` bands in each row and about ``rows`` rows, lines and
    bands being hashes; a line may be repeated. ``least`` is the smallest line of the band where ``whole`` is true. Elsewhere the band came in parts: ``least`` is the smallest line of
    a part, the least lines of parts are members of further parts, and a row may be repeated with another ``least``; so
    rows with their ``least`` connect all lines of the band.

    Bands travel as packed arrays, dealt by their hash into a number of buckets that follows ``rows``. A crowded band is
    put together by the tasks that read it: only its least line travels to the band's bucket, the others to buckets
    that follow from that line. A meeting task gives out what has met whenever it holds ``most_held`` entries, and keeps one
    line a band: its memory is bounded by the distinct bands of a bucket. No rows give an empty result.
    """
    cores = seen.sparkSession.sparkContext.defaultParallelism
    buckets = max(cores, rows * n_bands // per_task + 1)

    def dealt(values: np.ndarray) -> np.ndarray:
        return (values.view(np.uint64) >> np.uint64(17)) % np.uint64(buckets)

    def flushed(lines: list[np.ndarray], bands: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        line, first = np.unique(np.concatenate(lines), return_index=True)
        band = np.concatenate(bands).reshape(-1, n_bands)[first].ravel()
        member = np.repeat(line, n_bands)
        ordered = np.sort(band)
        crowds = np.unique(ordered[crowd - 1 :][ordered[crowd - 1 :] == ordered[: max(0, len(ordered) - crowd + 1)]])
        late = np.zeros(len(band), bool)
        if len(crowds):
            crowded = np.isin(band, crowds)
            (*least, flags), (own, members, leasts, _) = settle((band[crowded], member[crowded], late[crowded]), False)
            yield _packed(dealt(leasts), [own, members, leasts], apart=True)
            band, member = (np.concatenate([x[~crowded], y]) for x, y in zip((band, member), least, strict=True))
            late = np.concatenate([late[~crowded], flags])
        yield _packed(dealt(band), [band, member, late], apart=False)

    def emit(batches):
        lines, bands, size = [], [], 0
        for batch in batches:
            lines.append(batch.column(0).to_numpy(zero_copy_only=False))
            bands.append(batch.column(1).flatten().to_numpy(zero_copy_only=False))
            size += len(bands[-1])
            if size >= flush:
                yield from flushed(lines, bands)
                lines, bands, size = [], [], 0
        if size:
            yield from flushed(lines, bands)

    def given(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows[0]), _OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + _OUT_ROWS]) for c in rows], ["band", "line", "least", "whole"])

    def meet(batches):
        pool, size, most = [], 0, most_held
        for batch in batches:
            for _, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                band, member = (np.frombuffer(x, np.int64) for x in packed[:2])
                if packed[3] is not None:
                    yield from given([band, member, np.frombuffer(packed[3], np.int64), np.zeros(len(band), bool)])
                    continue
                pool.append((band, member, np.frombuffer(packed[2], bool)))
                size += len(band)
                if size >= most:
                    held, rows = settle(tuple(map(np.concatenate, zip(*pool, strict=True))), False)
                    yield from given(rows)
                    pool, size = [held], len(held[0])
                    most = max(most_held, 2 * size)
        if pool:
            yield from given(settle(tuple(map(np.concatenate, zip(*pool, strict=True))), True)[1])

    sent = seen.select("line", "bands").mapInArrow(emit, "bucket int, bands binary, lines binary, late binary, leasts binary")
    return sent.repartitionById(buckets, "bucket").mapInArrow(meet, "band long, line long, least long, whole boolean")
