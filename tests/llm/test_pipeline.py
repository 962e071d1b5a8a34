"""The pipeline against its stages worked out one after the other by brute force, and the registered queries."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from test_line_dedup import brute as brute_lines
from test_near_texts import brute_stay

import __spark_entry__ as entry_points
import corpus_pipeline
from footfall.llm.oracle import ORACLE
from footfall.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string"


def documents(seed=4, n=150):
    rng = random.Random(seed)
    syllables = {"en": "the an ing er on".split(), "fr": "eau oi ai ou é".split()}
    words = {g: ["".join(rng.choices(s, k=rng.randint(1, 4))) for _ in range(500)] for g, s in syllables.items()}
    rows, pool, long = [], [], []
    for doc_id in range(n):
        lang = rng.choice(["en", "fr"])
        draw = rng.random()
        if draw < 0.25 and pool:
            text = rng.choice(pool)
            if rng.random() < 0.6:
                parts = text.split(" ")
                parts[rng.randrange(len(parts))] = rng.choice(words[lang])
                text = " ".join(parts)
        elif draw < 0.3:
            text = rng.choice([None, "", "123 456", "   "])
        elif draw < 0.5:  # a text of many lines, or one with a line of which much is different
            if not long or rng.random() < 0.4:
                long.append([rng.choices(words[lang], k=12) for _ in range(14)])
            lines = [list(line) for line in rng.choice(long)]
            lines[rng.randrange(14)][3:7] = rng.choices(words[lang], k=4)
            text = "\n".join(map(" ".join, lines))
        else:
            text = "\n".join(" ".join(rng.choices(words[lang], k=rng.randint(5, 60))) for _ in range(rng.randint(1, 5)))
            pool.append(text)
            if rng.random() < 0.3:
                text += "\nan ing er on the footer of every page"
        rows.append((doc_id, text, lang if rng.random() < 0.9 else None, "s", len(text or ""), "x"))
    return rows


def test_rows_are_those_of_the_stages_by_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    left = brute_lines(kept)
    kept = [(i, left[i, t][0]) for i, t in kept if left[i, t][2] or not left[i, t][1]]
    whole = {i: t for i, t, *_ in rows}
    stay = set(brute_stay([(i, whole[i]) for i, _ in kept], corpus_pipeline.MIN_SIMILARITY))
    assert len(stay) < len(kept) - 10
    kept = {i: t for i, t in kept if i in stay}
    assert 20 < len(kept) < len(rows)

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in kept.items()}
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r)
    assert found.keys() == want.keys()
    for i, pieces in found.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(want[i][r.start : r.start + r.length])
            at += r.length
        assert at == len(want[i]) == pieces[0].doc_tokens


def test_no_stub_of_a_near_copy_stays(spark, tmp_path):
    """Copies that differ in two words of one line of twelve: their other lines go first, then what is left of them."""
    rng = random.Random(7)
    words = ["".join(rng.choices("the an ing er on".split(), k=3)) for _ in range(3000)]
    rows = []
    for n in range(40):
        lines = [rng.choices(words, k=12) for _ in range(12)]
        rows.append((n, "\n".join(map(" ".join, lines)), "en", "s", 0, None))
        lines[n % 12][3:5] = ["changed", "words"]
        rows.append((100 + n, "\n".join(map(" ".join, lines)), "en", "s", 0, None))
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = corpus_pipeline.lines(spark, df.drop("lang_pred"), str(tmp_path))
    assert docs.count() == 80
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in left) == list(range(40))
    # Documents that are not in the table, or not with that text, are judged by what they have.
    other = spark.createDataFrame([(500, rows[0][1], "en", "s", 0), (1, rows[1][1], "en", "s", 0)], docs.schema)
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, other, str(tmp_path)).collect()] == [1]


def test_stages_pass_documents_on(spark, tmp_path):
    df = spark.createDataFrame(documents(seed=6, n=40), SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        assert all(len(r.text) == r.n_chars for r in df.collect()) and df.count() > 0


def test_clean_texts_of_unseen_vocabulary_stay(spark):
    plain = "the old house by the river was sold last year and a young family lives there now, they keep a garden. "
    dull = "la maison de la rue est grande et les enfants jouent dans le jardin avec un petit chien. "
    human = "Everyone is entitled to all Rights and freedoms; without Distinction of any kind (race, colour, sex or Birth). "
    clean = ["A.", "OK", "Zyx Qv", human, human.upper() * 4, "Forty-six minus nineteen: twenty-seven! " * 5]
    foreign = ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * 4, "人人生而自由在尊严和权利上一律平等" * 5]
    rows = [(n, (plain if n % 2 else dull) + str(n), "en" if n % 2 else "fr", "s", 0) for n in range(40)]
    rows += [(100 + n, t, "en", "s", 0) for n, t in enumerate(clean)] + [(200 + n, t, None, "s", 0) for n, t in enumerate(clean)]
    rows += [(300 + n, t, None, "s", 0) for n, t in enumerate(foreign)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    train = corpus_pipeline.language.train
    try:
        corpus_pipeline.language.train = lambda docs: train(docs.filter("doc_id < 100"))
        got = corpus_pipeline.language_id(spark, df, "").collect()
    finally:
        corpus_pipeline.language.train = train
    assert sorted(r.doc_id for r in got) == [i for i, *_ in rows if i < 300]


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_queries_are_registered():
    assert QUERIES.items() <= entry_points.queries().items()
    assert ORACLE.items() <= entry_points.oracle_sql().items()
    assert {name.split("_")[0] for name in QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = connection.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf_dir).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
