"""Token counts, BPE, packing and ORC files against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from oracle_cases import awkward, empty, frame
from pyspark.sql import functions as F

from footfall.llm import bpe, packing, token_files, transducer
from footfall.llm.common import Scratch

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def noise(seed, n, most=60):
    rng = random.Random(seed)
    alphabet = "abcthe isS'tİIŁß9½² \n\t \x85\x1c\x1fé<|/w>,.!?-—中文😀éΣσςΑ’'llve ﬁ▁  \n"
    return ["".join(rng.choices(alphabet, k=rng.randint(0, most))) for _ in range(n)]


def prose(spark, sf_dir):
    return [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    odd = ["a<|endoftext|>b <|startoftext|>x", "<|endoftext|>", "</w>the</w>", "", " ", "x" * 3000, "ab " * 2000, "\0a"]
    return [*noise(1, 400), *odd, *(" " * n + "the" + " " * n for n in range(20)), *prose(spark, sf_dir)]


@pytest.mark.parametrize("chunk", [1 << 16, 50, 3])
def test_piece_counts(texts, chunk):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = transducer.TextCounter(PIECES)
    short = texts if chunk > 100 else [t for t in texts if len(t) < 500]
    assert [counter.count(t, chunk) for t in short] == [len(library.encode(t)) for t in short]


def test_maps_compose_in_any_grouping_and_from_any_place():
    counter = transducer.TextCounter(PIECES)
    for text in noise(2, 60, 40):
        chunks = [text[n : n + 4] for n in range(0, len(text), 4)]
        if len(chunks) < 3:
            continue
        # With every place that can be met as an entry, all is known.
        places = {counter.follow(text[:n], transducer.BEGINNING)[0] for n in range(len(text) + 1)}
        maps = [{p: counter.follow(c, p) for p in places} for c in chunks]
        left = maps[0]
        for m in maps[1:]:
            left = counter.compose(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = counter.compose(m, right)
        start = transducer.BEGINNING
        assert left[start] == right[start] == counter.scan(maps)[-1][start] == counter.follow(text, start)
        assert all(counter.scan(maps)[n][start] == counter.follow("".join(chunks[: n + 1]), start) for n in range(len(chunks)))
        assert counter.count(text) == counter.follow(transducer.spelled(text), start)[1]


def test_the_scan_leads_through_prose_and_unbroken_text(texts):
    counter, rng = transducer.TextCounter(PIECES), random.Random(8)
    unbroken = ["".join(rng.choices("etaoinshrdlucmfé", k=9000)), "ab" * 5000, "".join(rng.choices("中文字符号", k=4000))]
    for text in [t for t in texts if len(t or "") > 2000] + unbroken:
        text = transducer.spelled(text)
        chunks = [text[n : n + 500] for n in range(0, len(text), 500)]
        maps = [counter.chunk(c, b) for c, b in zip(chunks, ["", *chunks], strict=False)]
        assert counter.scan(maps)[-1][transducer.BEGINNING] == counter.follow(text, transducer.BEGINNING)
        packed = transducer._packed(maps[-1])
        assert transducer._unpacked(packed) == maps[-1] and len(packed) < 2000


def test_chunks_of_long_texts_are_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(9)
    texts = ["".join(rng.choices("etaoin", k=700)), "word and " * 90, "x" * 333, "short", None, "\n \n" * 200]
    rows = [(n, t) for n, t in enumerate([*texts, texts[0], texts[1]])] + [(None, texts[0]), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (3, 50, 300):
        got = transducer.token_counts(df, PIECES, 100, chunk).collect()
        counts = [len(library.encode(t or "")) for _, t in rows]
        want = [(i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, counts)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_text_is_read_by_many_tasks(spark):
    """A million characters without a space."""
    text = "".join(random.Random(10).choices("etaoinshrdlucmf", k=1_000_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    named = df.select(F.xxhash64("text").alias("x"), F.lit(0).cast("long").alias("y"), F.col("text").alias("body"))
    counts = transducer._long_counts(named, PIECES, 1 << 14)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(x" in plan and "number" in plan.split("hashpartitioning(x")[-1].split(")")[0]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [r.n_tokens for r in counts.collect()] == [len(library.encode(text))]


def test_forgetting_states_changes_no_count(monkeypatch):
    monkeypatch.setattr(transducer, "KNOWN_STATES", 5)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = transducer.TextCounter(PIECES)
    for text in noise(3, 50):
        assert counter.count(text) == len(library.encode(text))


def test_token_count_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = transducer.token_counts(frame(spark), PIECES, 4096).collect()
    want = []
    for doc_id, text, *_ in awkward():
        n = len(library.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 4096))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert transducer.token_counts(empty(spark), PIECES, 4096).collect() == []


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("backtracking", [True, False])
def test_whole_texts_encode_as_the_library_does(texts, path, backtracking):
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    encoder = bpe.TextEncoder(path, backtracking)
    for text in texts:
        ids = np.frombuffer(encoder.encode(text.encode()), "<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        if path == WORDS:
            assert encoder.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(5))
def test_backtracking_equals_merging(seed):
    """On random merges, where tokens that match best are often wrong."""
    rng = random.Random(seed)
    tokens, ranks = list("abc"), {}
    while len(ranks) < 60:
        pair = rng.choice(tokens), rng.choice(tokens)
        if pair not in ranks and len(pair[0] + pair[1]) < 9 and pair[0] + pair[1] not in tokens:
            ranks[pair] = len(ranks)
            tokens.append(pair[0] + pair[1])
    ids = {t: i for i, t in enumerate(tokens)}
    encoder = bpe.BacktrackingEncoder(ids, ranks)
    for _ in range(600):
        word = "".join(rng.choices("abc", k=rng.randint(1, 25)))
        assert encoder.encode(word) == [ids[t] for t in bpe.merged(list(word), lambda a, b: ranks.get((a, b)))]


def ids_of(path, text, end=None):
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids if end is None else [*ids, end], "<u4")


def test_encode_decode_rows(spark):
    library = tokenizers.Tokenizer.from_file(WORDS)
    want = []
    for doc_id, text, *_ in awkward():
        ids = ids_of(WORDS, text)
        decoded = library.decode(ids.tolist(), skip_special_tokens=False)
        digests = hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        want.append((doc_id, len(ids), *digests))
    got = bpe.encode_decode(frame(spark), WORDS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_decode(empty(spark), WORDS).collect() == []


def test_packed_rows(spark):
    rows = packing.pack_documents(frame(spark).coalesce(2), BYTES, 0).collect()
    documents = {}
    for doc_id, text, *_ in awkward():
        documents.setdefault(doc_id, []).append(ids_of(BYTES, text, 0))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in rows) == sum(len(d) for ds in documents.values() for d in ds)
    for doc_id, found in documents.items():
        for ids in found:
            own = [r for r in pieces[doc_id, len(ids)]]
            sums = {(r.start, r.length): zlib.crc32(ids[r.start : r.start + r.length]) for r in own}
            if len(found) == 1 or len({len(d) for d in found}) == len(found):
                assert sorted((r.start, r.length) for r in own) == sorted(sums)
                at = 0
                for r in sorted(own, key=lambda r: r.start):
                    assert r.start == at and r.ids_crc32 == sums[r.start, r.length]
                    at += r.length
                assert at == len(ids)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024
    assert packing.pack_documents(empty(spark), BYTES, 0).collect() == []


def test_orc_round_trip(spark):
    folder = Scratch(spark, "test-orc").path
    got = token_files.store_and_locate(frame(spark).repartition(3), WORDS, 2, folder).collect()
    encoded = {}
    for doc_id, text, *_ in awkward():
        encoded.setdefault(doc_id, []).append(ids_of(WORDS, text, 2))
    want = sorted((str(i), len(d), zlib.crc32(d)) for i, ds in encoded.items() for d in ds)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_orc_lookup_is_pushed_down(spark):
    folder = Scratch(spark, "test-orc").path
    token_files.write_ids(token_files.encode_sorted(frame(spark), WORDS, 2), folder)
    found = token_files.read_ids(spark, folder).where(F.col("doc_id") == 12)
    assert "EqualTo(doc_id,12)" in found._jdf.queryExecution().toString()
    assert [r.ids for r in found.collect()] == [ids_of(WORDS, "a b c d", 2).tolist()]


def test_empty_orc_table(spark):
    folder = Scratch(spark, "test-orc").path
    assert token_files.store_and_locate(empty(spark), WORDS, 2, folder).collect() == []
