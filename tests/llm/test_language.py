"""Code lengths against a plain implementation, and accuracy on held-out documents."""

import math
import random
import zlib
from collections import Counter

from oracle_cases import awkward, empty, frame

from footfall.llm import language as L


def plain_tree(texts):
    """Counts of each context of up to ``ORDER`` bytes, as a dict of counters."""
    tree = {}
    for text in texts:
        for at in range(len(text)):
            for order in range(L.ORDER + 1):
                # Contexts may reach over the beginning, which is marked by None.
                context = tuple(text[i] if i >= 0 else None for i in range(at - order, at))
                tree.setdefault(context, Counter())[text[at]] += 1
    return tree


def plain_bits(tree, text):
    total = 0.0
    for at, byte in enumerate(text):
        order = L.ORDER
        while True:
            if order < 0:
                total += 8
                break
            context = tuple(text[i] if i >= 0 else None for i in range(at - order, at))
            counts = tree.get(context)
            order -= 1
            if counts is None:
                continue
            n, kinds = sum(counts.values()), len(counts)
            if byte in counts:
                total -= math.log2(counts[byte] / (n + kinds))
                break
            total -= math.log2(kinds / (n + kinds))
    return total


def test_code_lengths_are_those_of_plain_trees(monkeypatch):
    monkeypatch.setattr(L, "PIECE_BYTES", 50)
    rng = random.Random(1)
    known = {
        name: ["".join(rng.choices(letters, k=rng.randint(1, 200))).encode() for _ in range(20)]
        for name, letters in (("a", "abcde é."), ("b", "cdefg ñ,"), ("c", "xyz "))
    }
    model = L.fit(known)
    trees = {name: plain_tree(texts) for name, texts in known.items()}
    texts = ["".join(rng.choices("abcdefgxyz éñ€Q", k=rng.randint(0, 170))).encode() for _ in range(40)]
    for text, row in zip(texts, L.code_lengths(model, texts)):
        for name, bits in zip(model.languages, row):
            # A byte that only another language knows has a context mark of its own there; costs agree all the same.
            assert abs(bits - plain_bits(trees[name], text)) <= (len(text) + 1) / L.UNIT


def test_awkward_rows(spark):
    model = L.train(frame(spark))
    assert model.languages == ("en",)
    got = L.identify(frame(spark), model, ["doc_id"]).collect()
    assert len(got) == len(awkward())
    want = {t: ("en" if t and any(c.isalpha() for c in t) else "und") for _, t, *_ in awkward()}
    assert Counter(r.lang_pred for r in got) == Counter(want[t] for _, t, *_ in awkward())
    assert all(0 <= r.score <= 1 for r in got)


def test_no_labels_no_language(spark):
    df = frame(spark, [(1, "words here", None, None, None, None, None)])
    assert [r.lang_pred for r in L.predict_held_out(df).collect()] == ["und"]
    assert L.predict_held_out(empty(spark)).collect() == []


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.lang for r in docs.collect()}
    got = L.predict_held_out(docs).collect()
    assert len(got) == len(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(labels[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held) > 0


def test_only_the_text_is_looked_at(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.train(docs)
    other = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source")
    one = {r.doc_id: r.lang_pred for r in L.identify(docs, model, ["doc_id"]).collect()}
    assert one == {r.doc_id: r.lang_pred for r in L.identify(other, model, ["doc_id"]).collect()}


def test_the_sample_is_bounded_and_fixed(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, two = L.train(docs, rows=5), L.train(docs.repartition(5), rows=5)
    assert one.languages == two.languages and (one.bits == two.bits).all() and (one.rows == two.rows).all()


def test_languages_of_few_usable_or_only_long_texts_are_learned(spark):
    rows = [(n, None if n % 3 else "", "few") for n in range(3000)]
    rows += [(5000 + n, f"peu de mots {n}", "few") for n in range(20)]
    rows += [(6000 + n, "é" + "lang und breit " * (10 + n), "long") for n in range(30)]
    rows += [(7000 + n, f"quite short {n}", "short") for n in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(df, rows=5, max_bytes=100)
    assert model.languages == ("few", "long", "short")
    got = L.identify(df.filter("doc_id >= 5000"), model, ["doc_id", "lang"]).collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_sample_and_trees_are_bounded_over_all_languages(spark):
    rng = random.Random(3)
    rows = [(n, "".join(rng.choices("abcdefghij ", k=200)) + f"{n % 40}" * 9, f"l{n % 40}") for n in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = []
    fit = L.fit
    try:
        L.fit = lambda samples: held.append(samples) or fit(samples)
        L.train(df, total=8000)
    finally:
        L.fit = fit
    assert len(held[0]) == 40 and sum(len(t) for ts in held[0].values() for t in ts) <= 8000
    samples = {f"l{n}": [t.encode() for i, t, _ in rows if i % 40 == n] for n in range(40)}
    model = L.fit(samples, 300_000)
    assert len(model.languages) == 40 and 0 < model.bits.nbytes <= 300_000 < L.fit(samples).bits.nbytes
