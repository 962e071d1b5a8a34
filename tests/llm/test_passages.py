import hashlib
import itertools
import random

import numpy as np
import pytest
from oracle_cases import awkward, empty, frame
from pyspark.sql import functions as F

from footfall.llm import passages


def brute(rows, window=passages.WINDOW):
    """``rows`` are (doc_id, key, text); rows of one key are one document."""
    order = sorted({(i is None, i or 0, key): (text or "").encode().split() for i, key, text in rows}.items())
    seen, left = set(), {}
    for (_, _, key), words in order:
        gone = set()
        for start in range(len(words) - window + 1):
            run = tuple(words[start : start + window])
            if run in seen:
                gone.update(range(start, start + window))
            seen.add(run)
        left[key] = (len(words), len(gone), b" ".join(w for n, w in enumerate(words) if n not in gone))
    digests = {k: (n, g, hashlib.sha256(t).hexdigest()) for k, (n, g, t) in left.items()}
    return sorted(((i, *digests[key]) for i, key, _ in rows), key=str)


def check(df, window=passages.WINDOW):
    text = F.coalesce("text", F.lit(""))
    rows = [tuple(r) for r in df.select("doc_id", F.xxhash64("doc_id", text), "text").collect()]
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    got = sorted((tuple(r) for r in passages.kept_digests(df, window).select(columns).collect()), key=str)
    assert got == brute(rows, window)
    return got


def shared_passages(seed, docs=150):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdef", k=4)) for _ in range(400)]
    parts = [rng.choices(words, k=rng.choice([5, 19, 20, 21, 33, 60, 90])) for _ in range(12)]
    rows = []
    for n in range(docs):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choices(words, k=rng.randint(0, 40))
            if rng.random() < 0.6:
                text += rng.choice(parts)
        if rows and rng.random() < 0.2:
            text = (rng.choice(rows)[1] or "").split()
            if text and rng.random() < 0.5:
                text[rng.randrange(len(text))] = "edited"
        rows.append((n * 7 % docs, rng.choice([" ", "\n", " \x0b "]).join(text)))
    return rows


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 13)])
def test_against_brute_force(spark, seed, window):
    df = spark.createDataFrame(shared_passages(seed), "doc_id long, text string").repartition(5)
    assert sum(r[2] for r in check(df, window)) > 500


def test_awkward_rows(spark):
    check(frame(spark))


def test_empty_table(spark):
    assert check(empty(spark)) == []


def test_hot_passages_and_repeats_inside_a_text(spark):
    hot = " ".join(f"h{n}" for n in range(50))
    rows = [(n, f"a{n} b{n} {hot} c{n}" if n % 3 else hot) for n in range(400)]
    rows += [(1000, "x " * 5000), (1001, "x " * 30), (1002, " ".join([hot, hot, hot])), (-3, "x " * 19)]
    rows += [(None, hot), (None, "x " * 25), (5, "other text of one id " * 8)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_any_two_windows_share_an_aligned_anchor():
    length, window = passages.WINDOW - passages.PERIOD + 1, passages.WINDOW
    cover = set(passages.cover_starts(200, length).tolist())
    for a, b in itertools.product(range(40), range(40)):
        assert any(a + d in cover and b + d in cover for d in range(passages.PERIOD))
    # A window is a candidate for each anchor inside it, and for no other.
    starts = passages.cover_starts(100, length)
    for place, at in enumerate(starts.tolist()):
        got = passages.candidate_starts(100, np.array([place]), window).tolist()
        assert got == [s for s in range(100 - window + 1) if s <= at and at + length <= s + window]


def test_too_short_a_window(spark):
    with pytest.raises(ValueError):
        passages.remove_repeats(empty(spark), 12)


def test_whole_table(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))
