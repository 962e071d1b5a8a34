import random

import numpy as np
import pytest
import xxhash
from oracle_cases import awkward, empty, frame

from footfall.llm import simhash
from footfall.llm.common import Scratch
from footfall.llm.components import connected_components


def brute_print(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = list(root)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {p: find(p) for p in every}


def check(df, rows):
    prints = [brute_print(t) for _, t, *_ in rows]
    root = brute_components(set(prints))
    least = {}
    for (doc_id, *_), p in zip(rows, prints):
        if doc_id is not None:
            least[root[p]] = min(doc_id, least.get(root[p], doc_id))
    want = sorted(((r[0], f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == want


def test_awkward_rows(spark):
    check(frame(spark), awkward())


def test_near_copies(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(800)]
    texts = [" ".join(rng.choices(words, k=rng.randint(60, 300))) for _ in range(40)]
    rows = []
    for n in range(250):
        parts = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 3)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append((n, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)
    stay = sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect())
    assert stay == sorted({r.component_id for r in simhash.near_duplicates(df).collect()})


@pytest.mark.parametrize("seed", [1, 2])
def test_no_link_is_lost(spark, seed):
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                p ^= 1 << b
            prints.add(p)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    scratch = Scratch(spark, "test-simhash")
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = simhash.links(df, len(signed), scratch)
    pairs = found.collect()
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in pairs)
    labels = {r.node: r.root for r in connected_components(found, scratch).collect()}
    want = brute_components({p & ((1 << 64) - 1) for p in signed})
    groups = {}
    for p in signed:
        groups.setdefault(want[p & ((1 << 64) - 1)], set()).add(labels.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(100)]
    shuffled = [(1000 + (i * 37) % 101, 1000 + ((i + 1) * 37) % 101) for i in range(100)]
    star = [(5000, 5000 + i) for i in range(1, 200)]
    links = spark.createDataFrame([*path, *shuffled, *star, (7, 7), (9000, 9000), (None, 3), (0, 1)], "a long, b long")
    got = {r.node: r.root for r in connected_components(links, Scratch(spark, "test-components")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(101)}, **{5000 + i: 5000 for i in range(200)}}


def test_rows_that_stay(spark):
    rows = [(1, "a b c d e f", "p"), (1, "a b c d e f", "p"), (2, "a b c d e f", "q"), (3, "quite other words in this one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    stay = sorted(tuple(r) for r in simhash.drop_near_duplicates(df.select("doc_id", "text")).collect())
    assert stay == [(1, "a b c d e f"), (3, "quite other words in this one")]


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
