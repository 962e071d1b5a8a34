"""Packing of token sequences by vector bin packing with the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from footfall.llm.bpe import TextEncoder
from footfall.llm.common import body, bounded_batches, worker_value

POOL = 1024  # examples considered together, and sequences that they could fill: bounds a task's memory, drops nothing


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold at most, in each dimension."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


def _cut(loss: np.ndarray, start: int, length: int) -> tuple[int, int]:
    """Tokens and loss-bearing tokens of a stretch, from running counts of the latter."""
    return length, int(loss[start + length] - loss[start])


class Packer:
    """Places examples into sequences. Every example is a key and a mask that tells its loss-bearing tokens.

    The examples of a pool are vectors of tokens, segments and loss-bearing tokens, in units of the limits. An open
    sequence takes the example with the largest dot product with what it has left, as long as one fits; then, if
    tokens are left over, the best example is cut to fill them. A sequence that can't be filled because another limit
    is reached gives back what is beyond a power of two, so that it needs no padding. The last one is split likewise.
    """

    def __init__(self, limits: Limits = Limits(), pool: int = POOL):
        self.limits, self.pool = limits, pool
        self.waiting: list[tuple[object, np.ndarray, int, int]] = []  # key, running loss counts, start, length
        self.tokens = 0  # of the examples that wait
        self.sequence = 0

    def add(self, key: object, loss: np.ndarray, rest: Callable[[int], object] | None = None) -> list[tuple]:
        """Take in an example; returns placements ``(key, start, length, sequence, offset)`` that are settled.

        With ``rest``, what has to wait goes by the key ``rest(start)``, its places counted from there: nothing of the
        stretch before it is kept.
        """
        counts = np.concatenate([[0], np.cumsum(loss)])
        length, start, placed = len(loss), 0, []
        whole = self.limits.tokens
        while length - start >= whole and counts[start + whole] - counts[start] <= self.limits.loss:
            placed.append((key, start, whole, self.sequence, 0))
            self.sequence += 1
            start += whole
        if length > start:
            self.tokens += length - start
            if rest is None:
                self.waiting.append((key, counts, start, length - start))
            else:
                self.waiting.append((rest(start), counts[start:] - counts[start], 0, length - start))
        if len(self.waiting) >= self.pool or self.tokens >= self.pool * self.limits.tokens:
            placed.extend(self._pack(keep_last=True))
        return placed

    def flush(self) -> list[tuple]:
        return self._pack(keep_last=False)

    def _pack(self, keep_last: bool) -> list[tuple]:
        most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        items, self.waiting, self.tokens = self.waiting, [], 0
        sizes = np.array([[n, 1, _cut(c, s, n)[1]] for _, c, s, n in items], float).reshape(-1, 3)
        open_ = np.ones(len(items), bool)
        placed: list[tuple] = []
        while open_.any():
            room, held = most.copy(), []  # held: (item, start, length)
            while True:
                fits = open_ & (sizes <= room).all(axis=1)
                weight = (sizes / most) @ (room / most)
                if fits.any() and (room[1] > 1 or sizes[fits, 0].max() == room[0]):
                    if room[1] <= 1:
                        fits &= sizes[:, 0] == room[0]
                    best = int(np.where(fits, weight, -1).argmax())
                    _, _, start, length = items[best]
                    held.append((best, start, length))
                    room -= sizes[best]
                    open_[best] = False
                    continue
                if room[0] < 1 or room[1] < 1 or room[2] < 1 or not open_.any():
                    break
                best = int(np.where(open_, sizes[:, 0] if room[1] <= 1 else weight, -1).argmax())
                key, counts, start, length = items[best]
                length = min(length, int(room[0]))
                # As far as the loss-bearing tokens allow; at least one token.
                reach = int(np.searchsorted(counts[start : start + length + 1] - counts[start], room[2], side="right")) - 1
                length = max(1, min(length, reach))
                held.append((best, start, length))
                room -= [length, 1, _cut(counts, start, length)[1]]
                self._shorten(items, sizes, open_, best, start + length)
            total = sum(length for _, _, length in held)
            if total == self.limits.tokens:
                placed.extend(self._place(items, held))
            elif keep_last and not open_.any() and total < self.limits.tokens:
                self.waiting = [(items[i][0], items[i][1], s, n) for i, s, n in held]
                self.tokens = total
            elif open_.any():
                keep = 1 << (total.bit_length() - 1)
                kept, given = self._split(held, keep)
                placed.extend(self._place(items, kept))
                for i, s, n in given:
                    key, counts, start, length = items[i]
                    end = start + length if open_[i] else s + n
                    items[i] = (key, counts, s, end - s)
                    sizes[i] = [end - s, 1, _cut(counts, s, end - s)[1]]
                    open_[i] = True
            else:
                while held:
                    total = sum(length for _, _, length in held)
                    kept, held = self._split(held, 1 << (total.bit_length() - 1))
                    placed.extend(self._place(items, kept))
        return placed

    @staticmethod
    def _shorten(items, sizes, open_, at: int, start: int) -> None:
        key, counts, begin, length = items[at]
        left = begin + length - start
        items[at] = (key, counts, start, left)
        if left:
            sizes[at] = [left, 1, _cut(counts, start, left)[1]]
        else:
            open_[at] = False

    @staticmethod
    def _split(held: list[tuple[int, int, int]], keep: int) -> tuple[list, list]:
        kept, given = [], []
        for i, start, length in held:
            here = min(length, keep)
            if here:
                kept.append((i, start, here))
            if length > here:
                given.append((i, start + here, length - here))
            keep -= here
        return kept, given

    def _place(self, items, held: list[tuple[int, int, int]]) -> list[tuple]:
        out, offset = [], 0
        for i, start, length in held:
            out.append((items[i][0], start, length, self.sequence, offset))
            offset += length
        self.sequence += 1
        return out


SCHEMA = (
    "doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " loss_tokens long"
)


def pack_documents(docs: DataFrame, path: str, end_id: int, limits: Limits = Limits()) -> DataFrame:
    """Encode every text, put ``end_id`` behind it, and pack all ids into sequences.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens``. All
    tokens but a text's first bear loss, since nothing before it predicts it. A full stretch of a long text is a
    sequence by itself; only what is left of each text is packed. A task packs its partition in pools of a bounded
    number of such remainders, of less than a sequence each, without a shuffle, and numbers its sequences from its
    partition's number on. Besides them it holds one batch of texts.

    Null and empty texts are packed too: their end id. Repeated rows and null ids are packed like all others; other
    columns are ignored. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        encoder: TextEncoder = worker_value(("library", path), lambda: TextEncoder(path, backtracking=False))
        packer = Packer(limits)
        first = TaskContext.get().partitionId() << 32
        end = np.array([end_id], "<u4").tobytes()
        key_type = None

        def rows(placed: list[tuple]) -> pa.RecordBatch:
            found = [
                (key, zlib.crc32(ids[s * 4 : (s + n) * 4]), total, before + s, n, q, o)
                for (key, total, before, ids), s, n, q, o in placed
            ]
            keys, sums, totals, starts, lengths, sequences, offsets = zip(*found, strict=True)
            loss = [n - (s == 0) for s, n in zip(starts, lengths, strict=True)]
            longs = (starts, lengths, sums, totals, [first + q for q in sequences], offsets, loss)
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(c, pa.int64()) for c in longs)], names)

        for batch in batches:
            key_type, placed = batch.schema.field(0).type, []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(raw.as_buffer().to_pybytes()) + end
                total = len(ids) // 4
                loss = np.ones(total, np.int8)
                loss[0] = 0
                placed.extend(packer.add((key, total, 0, ids), loss, lambda s: (key, total, s, ids[s * 4 :])))
            if placed:
                yield rows(placed)
        if placed := packer.flush():
            yield rows(placed)

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(key=key)
    names = [column.split()[0] for column in schema.split(",")]
    return docs.select("doc_id", body().alias("body")).mapInArrow(run, schema)
