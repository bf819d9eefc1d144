from __future__ import annotations

import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from gradeloom.llm import warc as W
from gradeloom.llm.queries import op7_warc

SCHEMA = "page_id long, url string, html string, key string, row long"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rng = random.Random(5)
    big = "<p>" + "x" * 1200 + "é</p>"
    rows = [(k, f"http://h{k % 7}.example.com/{rng.randrange(5)}?q=a b#f", rng.choice([big, "small", f"<b>{rng.random()}</b>" * 100]), "k", k) for k in range(120)]
    rows += [(200, None, None, None, None), (201, "http://[bad", "", None, None), (None, "http://h1.example.com/", big, None, None), (203, "http://h1.example.com/\r\nX: 1", big, "k", 1)]
    rows += [(204, "http://twice.example.com/", "t" * 2000, "k", 1)] * 2
    path = tmp_path_factory.mktemp("pages")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "pages.parquet"))
    return str(path), rows


def test_query(spark, pages, monkeypatch):
    monkeypatch.setattr(W, "LINES", 7)
    monkeypatch.setattr(W, "SHARD_ROWS", 40)
    folder, rows = pages
    got = op7_warc(spark, folder).collect()
    groups = defaultdict(list)
    for page_id, _, html, *_ in rows:
        groups[(html or "").encode()].append(page_id)
    want = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda p: (p is not None, p))
        for k, p in enumerate(ids):
            revisit = len(payload) >= 1000 and k + 1 < len(ids)
            want.append((p, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", ids[-1] if revisit else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_look_up(spark, pages, monkeypatch):
    """A key's captures and no others, wherever its lines fall in blocks."""
    monkeypatch.setattr(W, "LINES", 5)
    folder, rows = pages
    directory, captures = W.archive(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html"))
    assert [d[0] for d in directory] == sorted(d[0] for d in directory)
    for key in (W.url_key(rows[3][1]), W.url_key(None), "com,nowhere)/"):
        found = W.look_up(spark, directory, spark.createDataFrame([(key,)], "key string")).collect()
        assert sorted(map(str, (r["page_id"] for r in found))) == sorted(str(p) for p, u, *_ in rows if W.url_key(u) == key)
        for r in found:
            if r["record_type"] == "response":
                assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    file = captures.first()["file"].removeprefix("file://")
    with gzip.open(file) as f:  # members follow one another as one archive
        assert f.read().startswith(b"WARC/1.1\r\n")


def test_keys():
    assert W.url_key("https://www.b.example.com:8080/x/y?z=1#f") == "com,example,b)/x/y?z=1"
    assert W.url_key("http://A.com") == "com,a)/"
    assert " " not in W.url_key("http://a.com/x y\n") and W.url_key(None) == "-"


def test_blocks_of():
    firsts = ["a", "c", "c", "e"]
    assert list(W.blocks_of(firsts, "c")) == [0, 1, 2]
    assert list(W.blocks_of(firsts, "b")) == [0]
    assert list(W.blocks_of(firsts, "A")) == []
    assert list(W.blocks_of([], "a")) == []


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    directory, captures = W.archive(none)
    assert directory == [] and W.look_up(spark, directory, W.keys_of(none)).count() == 0


def test_a_common_page(spark, tmp_path, monkeypatch):
    """A page that most rows have, and urls that are null, equal and many."""
    from gradeloom.llm import warc as W

    monkeypatch.setattr(W, "COMMON", 5)
    monkeypatch.setattr(W, "LINES", 40)
    monkeypatch.setattr(W, "SHARD_ROWS", 100)
    rows = [(k, None if k % 3 else "http://a.b/c", "x" * 2000) for k in range(1500)]
    rows += [(2000 + k, f"http://h{k % 7}.org/{k}", f"{k // 2} " * 900) for k in range(200)] + [(None, None, "x" * 2000), (1499, None, "x" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    directory, captures = W.archive(pages)
    got = W.look_up(spark, directory, W.keys_of(pages)).collect()
    assert captures.count() == len(got) == len(rows)
    large = [r for r in got if r["payload_bytes"] == 2000]
    assert sum(r["record_type"] == "response" for r in large) == 1
    assert {r["refers_to"] for r in large if r["record_type"] == "revisit"} == {1499}
    pairs = [r for r in got if (r["page_id"] or 0) >= 2000 and r["payload_bytes"] >= 1000]
    assert len(pairs) == 200 and all((r["refers_to"] or r["page_id"]) % 2 == 1 for r in pairs)
    some = W.look_up(spark, directory, spark.createDataFrame([("org,h3)/3",), ("org,none)/",)], "key string")).collect()
    assert [r["page_id"] for r in some] == [2003]
