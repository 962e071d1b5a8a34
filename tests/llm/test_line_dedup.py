"""Fuzzy line deduplication against all pairs compared."""

import random

import pytest

from footfall.llm import line_dedup as L


def brute(docs, threshold=L.THRESHOLD):
    """``(doc_id, text) -> kept text`` by comparing all pairs of lines."""
    order = sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0))
    places, root = {}, {}
    for doc_id, text in order:
        for number, raw in enumerate(text.split("\n")):
            if line := L.normalised(raw):
                places.setdefault(line, (doc_id is None, doc_id or 0, text, number))
                root.setdefault(line, line)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {line: L.shingles(line) for line in root}
    lines = list(root)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if L.jaccard(sets[a], sets[b]) >= threshold:
                root[find(a)] = find(b)
    keeper = {}
    for line in lines:
        r = find(line)
        keeper[r] = min(keeper.get(r, places[line]), places[line], key=lambda p: (p[0], p[1], p[3]))
    out = {}
    for doc_id, text in order:
        kept = []
        total = alive = 0
        for number, raw in enumerate(text.split("\n")):
            line = L.normalised(raw)
            stays = not line or keeper[find(line)] == (doc_id is None, doc_id or 0, text, number)
            total += bool(line)
            alive += bool(line) and stays
            if stays:
                kept.append(raw)
        out[doc_id, text] = ("\n".join(kept) if alive or not total else "", total, alive)
    return out


def check(spark, rows, schema="doc_id long, text string, extra string"):
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    got = L.deduplicate_lines(df).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    result = {}
    for r in got:
        result.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_kept))
    expected = {}
    for doc_id, text in rows:
        value = (None, 0, 0) if text is None else want[doc_id, text]
        expected.setdefault(doc_id, []).append(value)
    key = lambda v: (v[0] is None, v)
    assert {k: sorted(v, key=key) for k, v in result.items()} == {k: sorted(v, key=key) for k, v in expected.items()}


def varied(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    pool = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(25)]
    rows = []
    for doc_id in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(pool) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(1, 30)))
            if rng.random() < 0.4:
                parts = line.split(" ")
                parts[rng.randrange(len(parts))] = rng.choice(words)
                line = " ".join(parts)
            if rng.random() < 0.2:
                line = "  " + line.upper()
            lines.append(line)
        rows.append((doc_id, "\n".join(lines)))
    return rows


def test_normalised_lines_have_single_spaces():
    rng = random.Random(9)
    signs = "aB é ß Σ İ 中😀   \t\r\x0b\x1c\x1f\x85\xa0\u2003\u2028\u3000\u200b\0\ud800"
    lines = ["", " ", "ΑΣ", *("".join(rng.choices(signs, k=rng.randrange(1, 9))) for _ in range(20_000))]
    assert [L.normalised(x) for x in lines] == [" ".join(x.lower().split()) for x in lines]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    check(spark, varied(seed, 120))


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a\n\na\nb"), (5, "b"), (6, long), (7, long + " end"), (8, "a"), (8, "c"),
            (9, "c\nd"), (9, "c\nd"), (10, "Ünï côdé 中文 😀\nünï  CÔDÉ 中文 😀")]
    check(spark, rows)


def test_null_id_comes_last(spark):
    df = spark.createDataFrame([(None, "same line of text"), (5, "same line of text")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.deduplicate_lines(df).collect()}
    assert got == {5: "same line of text", None: ""}


def test_crowded_bands_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(L, "FEW_LINES", 2)
    check(spark, varied(1, 120))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.deduplicate_lines(df).collect() == []


def test_chain_of_near_copies_is_one_component(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    line = words[:40]
    rows = []
    for n in range(60):
        line = list(line)
        line[n % 40] = words[40 + n]
        rows.append((n, " ".join(line)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in L.deduplicate_lines(df).collect() if r.n_kept)
    assert kept == [0]


def test_signatures_estimate_similarity():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    a = " ".join(words[:300])
    b = " ".join(words[:270] + words[300:330])
    real = L.jaccard(L.shingles(a), L.shingles(b))
    one, two = L.signatures([a, b])
    assert abs((one == two).mean() - real) < 0.2
    assert (L.signatures(["abc"])[0] == L.signatures(["abc"])[0]).all()


@pytest.mark.parametrize("block", [5, 500])
def test_lines_of_a_crowded_band_are_compared_in_blocks(spark, block):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    base = words[:60]
    lines = []
    for _ in range(120):
        line = list(base)
        for at in rng.sample(range(60), rng.randint(1, 5)):
            line[at] = rng.choice(words)
        lines.append(" ".join(line))
    lines.append("ab")
    sets = [L.shingles(x) for x in lines]
    rest = spark.createDataFrame([(1, n, n // 2, 0) for n in range(len(lines))], "band long, line long, root long, least long")
    texts = spark.createDataFrame(list(enumerate(lines)), "line long, content string")
    got = [tuple(r) for r in L.crossing_links(rest, texts, 0.8, block).collect()]
    assert all(L.jaccard(sets[a], sets[b]) >= 0.8 and a // 2 != b // 2 for a, b in got)

    def groups(links):
        root = list(range(len(lines)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in [*links, *((n, n + 1) for n in range(0, len(lines) - 1, 2))]:
            root[find(a)] = find(b)
        return {frozenset(m for m in range(len(lines)) if find(m) == find(n)) for n in range(len(lines))}

    every = [(a, b) for a in range(len(lines)) for b in range(a) if L.jaccard(sets[a], sets[b]) >= 0.8]
    assert groups(got) == groups(every)


def test_pairs_are_verified_exactly():
    rng = random.Random(4)
    lines = [L.normalised(x) for _, t in varied(7, 60) for x in t.split("\n") if x.strip()] + ["a", "ab", "abcdef", "abcdefg"]
    xs, ys = ([rng.choice(lines) for _ in range(3000)] for _ in range(2))
    for n, parts in enumerate(x.split(" ") for x in xs[:1500]):
        parts[rng.randrange(len(parts))] = "other"
        ys[n] = " ".join(parts)
    for threshold in (0.8, 0.5, 1.0):
        got = L.alike(xs, ys, threshold).tolist()
        assert got == [L.jaccard(L.shingles(x), L.shingles(y)) >= threshold for x, y in zip(xs, ys)]


def test_pairs_of_blocks_of_one_band_are_spread_over_tasks(spark):
    rest = spark.createDataFrame([(1, n, n) for n in range(40)], "band long, line long, root long")
    texts = spark.createDataFrame([(n, f"line {n} " * 9) for n in range(40)], "line long, content string")
    for limit in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            found = L.crossing_links(rest, texts, 0.8, block=5)
            plan = found._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        above = plan[plan.index("FlatMapGroupsInPandas") : plan.index("Generate explode")]
        assert "Exchange hashpartitioning(band" in above and "one#" in above.split("Exchange")[1]


@pytest.mark.parametrize("length", [40, 100, 1000])
def test_bands_meet_nearly_all_lines_that_are_alike(length):
    """Lines of a similarity of 0.8 to 0.85; recall is about 0.99, and 0.95 leaves room for chance."""
    rng, letters, met, tried = random.Random(length), "abcdefghijklmnopqrstuvwxyz    ", 0, 0
    edits = max(1, round(0.09 * length / L.SHINGLE_CHARS))
    while tried < 200:
        line = rng.choices(letters, k=length)
        other = list(line)
        for place in rng.sample(range(length), edits):
            other[place] = rng.choice(letters)
        one, two = "".join(line), "".join(other)
        if one == two or not 0.8 <= L.jaccard(L.shingles(one), L.shingles(two)) <= 0.85:
            continue
        keys = L.bands(L.signatures([one, two]))
        met, tried = met + bool((keys[0] == keys[1]).any()), tried + 1
    assert met >= 0.95 * tried
