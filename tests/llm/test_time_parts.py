"""Adaptive time partitions against the contract's own words, in plain Python."""

from __future__ import annotations

import calendar
import datetime as dt
import hashlib
import os
import random
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gradeloom.llm.queries import moment, op12_time_parts
from gradeloom.llm.time_parts import fold, merge, rewrite, trie_of

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string"


def moved(ts, click_id):
    k = zlib.crc32(str(click_id).encode()) % 128
    if ts is None:
        return None
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    if k > 111:
        return dt.datetime.combine(ts.date() - dt.timedelta(days=ts.weekday()), dt.time())
    return ts


def leaves(moments, limit):
    """[(name, the function of its moments)]"""
    out = []

    def walk(members, above, level, rows):
        run = None
        for value, text in members:
            own = [m for m in rows if key(m, level) == value]
            if len(own) > limit and level < 3:
                run = None
                walk(below(value, level), f"{above}{text}/", level + 1, own)
            elif run and len(own) <= limit and len(run[3]) + len(own) <= limit:
                run[2], run[3] = text, run[3] + own
            else:
                run = [above, text, text, own]
                out.append(run)

    known = [m for m in moments if m is not None]
    if known:
        walk([((y,), f"{y:04d}") for y in range(min(known).year, max(known).year + 1)], "", 0, known)
    found = [(f"{a}{x}-{y}", Counter(own)) for a, x, y, own in out if own]
    return found + ([("null", Counter({None: len(moments) - len(known)}))] if len(known) < len(moments) else [])


def key(m, level):
    return (m.year, m.month, m.day, m.hour)[: level + 1]


def below(value, level):
    if level == 0:
        return [((*value, m), f"{m:02d}") for m in range(1, 13)]
    if level == 1:
        return [((*value, d), f"{d:02d}") for d in range(1, calendar.monthrange(*value)[1] + 1)]
    return [((*value, h), f"{h:02d}") for h in range(24)]


def files(rows, limit):
    """{(leaf, part): rows in order}"""
    of = {}
    for r in rows:
        of.setdefault(moved(r[1], r[0]), []).append(r)
    out = {}
    for name, held in leaves([moved(r[1], r[0]) for r in rows], limit):
        own = [r for m in held for r in of[m]]
        own.sort(key=lambda r: (moved(r[1], r[0]) or dt.datetime.min, r[2] or dt.datetime.min, r[0]))
        for k in range(0, len(own), limit):
            out[name, k // limit + 1] = own[k : k + limit]
    return out


def expected(rows, limit, cut):
    first, last = files([r for r in rows if r[2] and r[2] < cut], limit), files(rows, limit)
    started = Counter(map(str, (r for x in first.values() for r in x)))
    out = {}
    for at, own in last.items():
        stays = at in first and Counter(map(str, first[at])) == Counter(map(str, own))
        out[at] = (len(own), sum(str(r) not in started for r in own), not stays, hashlib.sha256(",".join(str(r[0]) for r in own).encode()).hexdigest())
    return out


def made(seed, n, hot):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        ts = start + dt.timedelta(seconds=rng.randrange(120 * 86400)) if rng.random() > hot else dt.datetime(2024, 2, 5, 7, rng.randrange(3))
        ts = None if rng.random() < 0.08 else ts
        arrived = (ts or start) + dt.timedelta(seconds=rng.randrange(3)) + dt.timedelta(days=40 if rng.random() < 0.05 else 0)
        rows.append((k, ts, None if rng.random() < 0.01 else arrived, rng.choice("ab")))
    return rows + rng.choices(rows, k=n // 20) + [rows[0]] * (n // 10)


CUT = dt.datetime(2024, 4, 1)


@pytest.mark.parametrize(("n", "hot", "limit"), [(3000, 0.0, 40), (3000, 0.5, 60), (400, 0.2, 1), (50, 0.0, 1000)])
def test_brute_force(spark, n, hot, limit):
    rows = made(n, n, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rewrite(df, moment(F.col("ts"), F.col("click_id")), ["arrived_at", "click_id"], limit, F.col("arrived_at") < F.lit(str(CUT)).cast("timestamp_ntz"), "click_id").collect()
    want = expected(rows, limit, CUT)
    assert {(r.leaf, r.part): (r.n_rows, r.n_new, r.rewritten, r.ids_sha256) for r in got} == want
    assert len(got) == len(want)
    paths = {r.path.removeprefix("file://") for r in got}
    folder = os.path.dirname(next(iter(paths)))
    assert {os.path.join(folder, f) for f in os.listdir(folder)} == paths
    back = Counter()
    for r in got:
        t = pq.read_table(r.path.removeprefix("file://"))
        assert ",".join(t.column_names) == r.columns == "click_id,ts,arrived_at,kind"
        assert hashlib.sha256(",".join(map(str, t.column("click_id").to_pylist())).encode()).hexdigest() == r.ids_sha256
        back.update(map(str, (tuple(x.values()) for x in t.to_pylist())))
    assert back == Counter(map(str, rows))


def test_equal_rows_recur_after_a_shift(spark):
    """A file stays if the same rows come back to its place, however they got there."""
    row = (1, dt.datetime(2024, 2, 5, 7), dt.datetime(2024, 2, 5, 8))
    rows = [(*row, "x")] * 9 + [(0, dt.datetime(2024, 2, 5, 7), dt.datetime(2024, 2, 5, 7), "new")]
    got = rewrite(spark.createDataFrame(rows, SCHEMA), F.col("ts"), ["arrived_at", "click_id"], 3, F.col("kind") == "x", "click_id").collect()
    assert {(r.part, r.n_rows, r.n_new, r.rewritten) for r in got} == {(1, 3, 1, True), (2, 3, 0, False), (3, 3, 0, False), (4, 1, 0, True)}


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rewrite(none, F.col("ts"), ["arrived_at"], 1, F.lit(True), "click_id").count() == 0
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 5, "p", 2)], "click_id long, ts timestamp_ntz, part long, leaf string, n_rows long")
    (r,) = rewrite(df, F.col("ts"), ["part"], 1, F.lit(False), "click_id").collect()
    assert (r.leaf, r.part, r.columns) == ("2024-2024", 1, "click_id,ts,part,leaf,n_rows")


def test_tries_merge_in_any_order():
    rng = random.Random(3)
    import numpy as np

    hours = np.array([rng.randrange(400_000, 480_000) for _ in range(5000)])
    parts = [trie_of(x) for x in np.array_split(hours, 7)]
    rng.shuffle(parts)
    total: dict = {}
    for p in parts:
        merge(total, p)
    assert [(x.name, x.rows) for x in fold(total, 50)] == [(x.name, x.rows) for x in fold(trie_of(hours), 50)]
    assert sum(x.rows for x in fold(total, 50)) == 5000


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_query(spark):
    rows = [(r.click_id, r.ts, r.arrived_at) for r in spark.read.parquet("/root/testdata/sf0.001/clicks.parquet").select("click_id", "ts", "arrived_at").collect()]
    got = op12_time_parts(spark, "/root/testdata/sf0.001").collect()
    want = expected(rows, 1 + len(rows) // 800, CUT)
    assert {(r.leaf, r.part): (r.n_rows, r.rewritten, r.ids_sha256) for r in got} == {k: (v[0], v[2], v[3]) for k, v in want.items()}
