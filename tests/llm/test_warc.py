import base64
import gzip
import hashlib
import random

import pytest

from footfall.llm import warc
from footfall.llm.common import Scratch

SCHEMA = "page_id long, url string, html string, record_type string, sha1 string, n long"


def page(page_id, url, html):
    return (page_id, url, html, "own", None, 7)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


PAGES = [
    page(1, "http://a/é x?q=1", "<p>hällo 😀</p>\r\n\r\nWARC/1.1\r\n"),
    page(2, None, None),
    page(3, "http://b", ""),
    page(4, "http://c", "same"),
    page(9, "http://d", "same"),
    page(7, "http://e", "same"),
    page(7, "http://e", "same"),
    page(None, "http://f", "no id"),
    page(11, "http://g\r\nX: y", "".join(random.Random(1).choices("abc\n\r é", k=700_000))),
    page(14, "http://x/a%2Fb?q=%C3%A9&r=a%20b", "percent signs"),
    page(15, "http://x/é%2F ", "percent signs and more"),
    page(16, " leading and trailing ", "spaces"),
    page(12, "http://h", "x" * 262_144),
    page(13, "http://i", "x" * 262_145),
]


def expected(pages, min_bytes=0):
    out = []
    for page_id, _, html, *_ in pages:
        html = html or ""
        same = [p[0] for p in pages if (p[2] or "") == html]
        keep = max((i for i in same if i is not None), default=None)
        alone = len(html.encode()) < min_bytes or len(same) == 1 or keep == page_id
        kind = ("response", None) if alone else ("revisit", keep)
        out.append((page_id, len(html.encode()), digest(html), *kind))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_records_of_awkward_pages(spark, min_bytes):
    got = warc.store_and_index(spark.createDataFrame(PAGES, SCHEMA), Scratch(spark, "test-warc"), min_bytes)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(PAGES, min_bytes)


def test_empty_table(spark):
    assert warc.store_and_index(spark.createDataFrame([], SCHEMA), Scratch(spark, "test-warc")).collect() == []


def archives(spark, chunk_bytes):
    scratch = Scratch(spark, "test-warc")
    records = warc.plan_records(spark.createDataFrame(PAGES, SCHEMA), scratch)
    chunks = warc.to_chunks(records, chunk_bytes)
    return scratch.table(warc.write_archives(chunks, f"{scratch.path}/archives"), "files")


@pytest.mark.parametrize("written, read", [(1000, 777), (1 << 18, 1 << 18), (70_000, 1 << 20)])
def test_chunks_carry_payloads_and_running_digests(spark, written, read):
    rows = warc.read_archives(archives(spark, written), read).collect()
    records = {}
    for r in rows:
        if r.record_type == "response":
            records.setdefault((r.record_id, r.target_uri), []).append(r)
    for page_id, url, html, *_ in PAGES:
        if html in ("same", None):  # revisits among them
            continue
        parts = sorted(records[str(page_id) if page_id is not None else "", url or ""], key=lambda r: r.chunk_no)
        assert [p.chunk_no for p in parts] == list(range(len(parts)))
        assert b"".join(p.data for p in parts) == (html or "").encode()
        assert all(len(p.data) <= read for p in parts) and [p.is_last for p in parts] == [False] * (len(parts) - 1) + [True]
        at, so_far = 0, hashlib.sha1()
        for p in parts:
            at += len(p.data)
            so_far.update(p.data)
            assert p.payload_bytes == at and p.payload_digest == base64.b32encode(so_far.digest()).decode()


def test_archives_are_concatenated_gzip_members(spark):
    for row in archives(spark, 1 << 18).collect():
        with gzip.open(row.path) as file:
            text = file.read()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        assert b"\r\nX: y" not in text


def test_a_damaged_archive_fails(spark, tmp_path):
    head = warc._head("1", "u", None, 4, hashlib.sha1(b"good").hexdigest())
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(head + b"evil\r\n\r\n"))
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string")
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(files).collect()
