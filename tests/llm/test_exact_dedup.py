import hashlib

from oracle_cases import awkward, empty, frame

from footfall.llm.exact_dedup import exact_duplicates


def expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        same = groups[text or ""]
        keep = max((i for i in same if i is not None), default=None)
        out.append((doc_id, keep, len(same), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_awkward_rows(spark):
    got = exact_duplicates(frame(spark), digest_all=True)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == expected(awkward())
    kept = {}
    for r in rows:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_only_rows_that_share_length_and_prefix_are_hashed(spark):
    same = "p" * 300
    rows = [(1, "abc"), (2, "xyz"), (3, "abcd"), (4, same + "a"), (5, same + "b"), (6, same + "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {r.doc_id: r for r in exact_duplicates(df).collect()}
    assert {i for i, r in hashed.items() if r.text_sha256} == {4, 5, 6}
    assert {i for i, r in hashed.items() if not r.kept} == {4}


def test_one_large_group(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'copy', CAST(id AS STRING)) AS text")
    rows = exact_duplicates(df).collect()
    assert len(rows) == 5000 and sum(r.kept for r in rows) == 5000 - 1667 + 1
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id % 3 == 0} == {(4998, 1667)}


def test_empty_table(spark):
    assert exact_duplicates(empty(spark)).collect() == []
