import hashlib
import random

import pytest
from oracle_cases import awkward, empty, frame
from pyspark.sql import functions as F

from footfall.llm import sketches


def edited(rows):
    """The edited text of each row, by the plain rule, for rows whose ids do not repeat."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for n, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        k = len(text) // 4
        out[doc_id] = text[: len(text) - k] + after[:k]
    return out


def test_awkward_rows(spark):
    seen, rows = set(), []
    for row in awkward():
        if row[0] not in seen:
            rows.append(row)
            seen.add(row[0])
    got = {r.doc_id: r for r in sketches.edited_likeness(frame(spark, rows)).collect()}
    want = edited(rows)
    assert got.keys() == want.keys()
    for doc_id, text, *_ in rows:
        r = got[doc_id]
        assert r.n_chars == len(text or "")
        assert r.edited_sha256 == hashlib.sha256(want[doc_id].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[5].fingerprint == got[1].fingerprint == got[9].fingerprint
    assert got[6].near_edited > 0.7 and got[6].near_next > 0.95


def test_repeated_ids_keep_their_rows(spark):
    rows = sketches.edited_likeness(frame(spark)).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((r[0] for r in awkward()), key=str)


def test_likeness_follows_the_edit(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=400))) for i in range(60)]
    got = sketches.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert abs(sum(r.near_edited for r in got) / 60 - 0.75) < 0.03
    assert max(r.near_next for r in got) == 0


@pytest.mark.parametrize("text", ["", "  ", "one two", "a b c d e", "a b c d e f g h a b c d e", "A  b\tC d\ne f"])
def test_sketch_is_the_hashes_below_the_threshold(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(sketches.sketch(F.col("t"), scale=1), sketches.sketch(F.col("t"), scale=2))
    every, some = row.head()
    n = len(text.split())
    shingles = {tuple(text.lower().split()[i : i + 5]) for i in range(max(1, n - 4))} if n else set()
    assert len(every) == len(shingles) and every == sorted(every)
    assert some == [h for h in every if h < 0]


def test_sketches_of_parts_merge(spark):
    a, b = sketches.sketch(F.lit("a b c d e f g"), scale=1), sketches.sketch(F.lit("h i j k l m"), scale=1)
    row = spark.range(1).select(sketches.merge(a, b), a, b, sketches.containment(a, sketches.merge(a, b)), sketches.containment(a, b)).head()
    assert row[0] == sorted({*row[1], *row[2]}) and row[3] == 1 and row[4] == 0


def test_empty_table(spark):
    assert sketches.edited_likeness(empty(spark)).collect() == []
