from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from gradeloom.llm import sharding as S
from gradeloom.llm.queries import op6_sharding


def test_query(spark, folder, rows, monkeypatch):
    monkeypatch.setattr(S, "PART_ROWS", 2)
    got = op6_sharding(spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in rows)
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots))) and 0 <= shard < 40
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got)


def test_growth_takes_rows_only_into_the_new_shard(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    for n in (1, 3, 7, 8, 9, 16, 40):
        got = S.place(ids, "doc_id", [1.0] * n, more=[1.0] * (n + 1)).collect()
        moved = [r for r in got if r["shard"] != r["grown_shard"]]
        assert {r["grown_shard"] for r in moved} == {n}
        assert abs(len(moved) / 4000 - 1 / (n + 1)) < 0.05


def test_weights(spark):
    """Shares follow weights; rows move only into the subtree that grew heavier, and in it."""
    ids = spark.range(8000).withColumnRenamed("id", "doc_id")
    a, b = [1.0, 2.0, 1.0, 4.0, 1.0, 1.0], [1.0, 2.0, 1.0, 4.0, 3.0, 1.0]
    x = {r["doc_id"]: r["shard"] for r in S.place(ids, "doc_id", a).collect()}
    y = {r["doc_id"]: r["shard"] for r in S.place(ids, "doc_id", b).collect()}
    n = Counter(x.values())
    assert all(abs(n[k] / 8000 - w / sum(a)) < 0.03 for k, w in enumerate(a))
    moved = {d for d in x if x[d] != y[d]}
    assert {y[d] for d in moved} == {4, 5} and 0.15 < len(moved) / 8000 < 0.3
    m = Counter(y.values())
    assert all(abs(m[k] / 8000 - w / sum(b)) < 0.03 for k, w in enumerate(b))


def test_rows_descend_the_tree(spark, monkeypatch):
    """Racks and regions decide where a row lies, and a hash a child of one node at a time."""
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    own = lambda: {r["doc_id"]: r["shard"] for r in S.place(ids, "doc_id", [1.0] * 24).collect()}
    before = own()
    monkeypatch.setattr(S, "RACK", 3)
    after = own()
    assert sum(before[d] != after[d] for d in before) > 2000
    n = Counter(after.values())
    assert all(abs(n[k] - 125) < 50 for k in range(24))


def test_many_equal_rows(spark, monkeypatch):
    """Rows that are all alike are numbered in many parts."""
    monkeypatch.setattr(S, "PART_ROWS", 100)
    docs = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = S.shard(docs, [1.0] * 4, [1.0] * 5).collect()
    assert sorted(r["slot"] for r in got) == list(range(10_000)) and len({r["shard"] for r in got}) == 1


def test_empty(spark, no_docs):
    assert S.shard(no_docs, [1.0] * 4, [1.0] * 5).count() == 0
