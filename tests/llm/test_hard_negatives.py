import math
import random

import numpy as np
import pytest

from footfall.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, block string"


def usable(vec_id, vector, label):
    if vec_id is None or vector is None or label is None:
        return False
    return all(x is not None and math.isfinite(x) for x in vector)


def brute(rows, every=50, n_positives=5, n_negatives=3, low=50, high=95):
    least = {}
    for vec_id, vector, label in rows:
        if usable(vec_id, vector, label):
            whole = (label, [float(np.float32(x)) for x in vector])
            least[vec_id] = min(whole, least.get(vec_id, whole))
    dims = max((len(v) for _, v in least.values()), default=0)
    ints = {i: [math.floor(256 * x) for x in v] + [0] * (dims - len(v)) for i, (_, v) in least.items()}
    out = []
    for anchor in ints:
        if anchor % every:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(ints[anchor], v)), i) for i, v in ints.items() if i != anchor)
        label = least[anchor][0]
        for score, positive in [x for x in ranked if least[x[1]][0] == label][:n_positives]:
            inside = [(s, i) for s, i in ranked if least[i][0] != label and low * -score <= 100 * -s <= high * -score]
            for rank, (s, i) in enumerate(inside[:n_negatives], 1):
                out.append((anchor, positive, rank, i, -score, -s))
    return sorted(out)


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, v, x, "r", None) for i, v, x in rows], SCHEMA).repartition(5)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in hn.mine(df, **how).select(columns).collect())
    assert got == brute(rows, **{k: v for k, v in how.items() if k != "codewords"})
    return got


def clustered(seed, count, dims=8, labels=4, copies=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels + 3, dims))
    rows = []
    for n in range(count):
        vector = centres[rng.integers(len(centres))] + rng.normal(size=dims) * 0.3
        if rng.random() < copies:
            vector = centres[0]
        rows.append((n, [float(x) for x in vector], int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize("codewords", [1, 6])
def test_against_brute_force(spark, monkeypatch, codewords):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 60)
    monkeypatch.setattr(hn, "FIRST_ROWS", 40)
    monkeypatch.setattr(hn, "CHUNK_ANCHORS", 20)
    assert len(check(spark, clustered(codewords, 700), every=10, codewords=codewords)) > 500


def test_a_hot_vector_and_ties(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 50)
    monkeypatch.setattr(hn, "FIRST_ROWS", 30)
    check(spark, clustered(3, 500, copies=0.5), every=25)


def test_awkward_rows(spark):
    rows = clustered(4, 60, dims=3, labels=2)
    rows += [(None, [1.0, 1.0, 1.0], 1), (1000, None, 1), (1050, [1.0, None, 1.0], 1), (1100, [1.0, 2.0, 3.0], None)]
    rows += [(1150, [float("nan"), 1.0, 1.0], 0), (1200, [float("inf"), 1.0, 1.0], 0), (1250, [], 1), (1300, [2.0], 0)]
    rows += [(1300, [2.0], 0), (1350, [0.5, 0.5, 0.5], 1), (1350, [0.5, 0.5, 0.5], 0), (1400, [1.0, 2.0, 3.0, 9.0], 0)]
    rows += [(-50, [100.0, -3.5, 2.0], 1), (1450, [0.0, 0.0, 0.0], -3)]
    check(spark, rows)


def test_large_components(spark):
    rng = random.Random(5)
    rows = [(n, [rng.uniform(-1, 1) * 8e5 for _ in range(4)], n % 2) for n in range(40)]
    check(spark, rows, every=5)
    too_large = spark.createDataFrame([(0, [1e9], 0, "r", None)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        hn.mine(too_large).collect()


def test_nothing_to_mine(spark):
    assert check(spark, []) == []
    assert check(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert check(spark, [(50, [1.0], 0)]) == []


def test_cells_come_by_falling_bounds_and_bounds_hold(spark):
    rng = np.random.default_rng(6)
    points = rng.integers(-300, 300, size=(400, 6)).astype(float)
    words = hn._fit(points[:, :3], 5), hn._fit(points[:, 3:], 5)
    (i, far_i), (j, far_j) = hn._nearest(points[:, :3], words[0]), hn._nearest(points[:, 3:], words[1])
    cells = i * 5 + j
    radii = tuple(np.array([far[near == k].max(initial=0) for k in range(5)]) for near, far in ((i, far_i), (j, far_j)))
    counts = np.bincount(cells, minlength=25)
    index = hn.Index(words, radii, counts, np.arange(25), np.ones(25, int))
    for query in points[:20]:
        visits = list(index.visits(query))
        bounds = [b for b, _ in visits]
        assert bounds == sorted(bounds, reverse=True)
        assert sorted(c for _, c in visits) == np.flatnonzero(counts).tolist()
        for bound, cell in visits:
            assert (points[cells == cell] @ query).max() <= bound + 1e-6
        # Blocks left out hold nothing that reaches the least score.
        least = float(np.sort(points @ query)[-5])
        looked = set(index.blocks(query, None)) | set(index.blocks(query, least))
        assert set(cells[points @ query >= least].tolist()) <= looked


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert check(spark, rows)
