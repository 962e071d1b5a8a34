"""The packer alone: nothing lost, limits kept, little padding."""

import tracemalloc

import numpy as np
import pytest

from footfall.llm.packing import Limits, Packer


def place(examples, limits, pool):
    packer, placed = Packer(limits, pool), []
    for key, loss in enumerate(examples):
        placed += packer.add(key, np.asarray(loss, np.int8))
    return placed + packer.flush()


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 8, 64), Limits(64, 4, 40), Limits(16, 2, 5)])
@pytest.mark.parametrize("seed", range(6))
def test_every_token_once_within_limits(limits, seed):
    random = np.random.default_rng(seed)
    top = [3, 40, 300, 3000, 2, 70][seed]
    examples = [random.random(random.integers(1, top)) < 0.7 for _ in range(400)]
    placed = place(examples, limits, pool=64)
    seen = {key: np.zeros(len(loss), int) for key, loss in enumerate(examples)}
    sequences: dict[int, list] = {}
    for key, start, length, sequence, offset in placed:
        assert length >= 1
        seen[key][start : start + length] += 1
        sequences.setdefault(sequence, []).append((offset, length, int(np.sum(examples[key][start : start + length]))))
    assert all((counts == 1).all() for counts in seen.values())
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at == limits.tokens or at & (at - 1) == 0
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(loss for _, _, loss in pieces) <= limits.loss


def test_pieces_are_mostly_whole():
    random = np.random.default_rng(0)
    examples = [np.ones(random.integers(100, 1000), bool) for _ in range(2000)]
    placed = place(examples, Limits(), pool=500)
    assert len(placed) < 3200
    used = len({q for *_, q, _ in placed})
    assert used <= sum(map(len, examples)) // 1024 + 11  # the last one is split into powers of two


def test_nothing_in_nothing_out():
    assert place([], Limits(), 8) == []


def test_what_waits_is_bounded_however_long_texts_are():
    """Remainders alone are kept: of texts of a million tokens, less than a sequence each."""
    tracemalloc.start()
    packer, seen, total = Packer(Limits(), pool=64), np.zeros(200, int), 1_000_000 + 517
    for key in range(200):
        ids = bytes(4 * total)
        for (name, _, base, held), start, length, *_ in packer.add(
            (key, total, 0, ids), np.ones(total, np.int8), lambda s: (key, total, s, ids[4 * s :])
        ):
            assert len(held[4 * start : 4 * (start + length)]) == 4 * length and base + start + length <= total
            seen[name] += length
        del ids, held
    waiting, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    for (name, *_), _, length, *_ in packer.flush():
        seen[name] += length
    assert (seen == total).all()
    assert waiting < 64 * 1024 * 16 + 4_000_000


def test_rest_keys_give_the_same_pieces():
    random = np.random.default_rng(3)
    examples = [random.random(random.integers(1, 4000)) < 0.9 for _ in range(300)]
    packer, placed = Packer(Limits(), 50), []
    for key, loss in enumerate(examples):
        placed += packer.add((key, 0), loss, lambda s: (key, s))
    placed += packer.flush()
    assert [(k, base + s, *more) for (k, base), s, *more in placed] == place(examples, Limits(), 50)
