from __future__ import annotations

import math

import numpy as np
import pytest

from gradeloom.llm import neighbours as N
from gradeloom.llm.queries import op4_neighbours


def brute(rows, k=20):
    own = {}
    for vec_id, v in rows:
        if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            own[vec_id] = np.array(v, np.float32).astype(float)
    out = {}
    for q, x in own.items():
        if q % 20 == 0:
            near = sorted((-float(x @ y), i) for i, y in own.items() if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(k, (centres[k % 12] + 0.3 * rng.standard_normal(16)).tolist()) for k in range(900)]
    same = [1.0, 2.0, *[0.5] * 14]
    rows += [(1000 + k, same) for k in range(120)]  # ties beyond k
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16), (2005, [float("inf")] * 16), (2020, [1.0, 2.0]), (2021, [2.0, 1.0]), (None, same), (3000, same), (3000, same)]
    return rows


def check(got, want):
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(found) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, w in want.items():
        mine = found.get(q, [])
        assert [r for *_, r in mine] == list(range(1, len(w) + 1))
        assert [(i, s) for i, s, _ in mine] == sorted(((i, s) for i, s, _ in mine), key=lambda x: (-x[1], x[0]))
        hits += len({i for i, *_ in mine} & {i for i, _ in w})
        total += len(w)
    assert hits >= 0.9 * total
    return found


def test_query(spark, vectors, tmp_path):
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    want = brute(vectors)
    found = check(op4_neighbours(spark, str(tmp_path)).collect(), want)
    exact = {q: dict(w) for q, w in want.items()}
    for q, mine in found.items():
        for i, s, _ in mine:
            if i in exact[q]:
                assert s == pytest.approx(exact[q][i], abs=1e-9)
    # equal vectors: the smallest ids
    assert [i for i, *_ in found[1000]] == list(range(1001, 1021))


def test_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(N, "INDEX_ROWS", 200)
    monkeypatch.setattr(N, "QUERY_ROWS", 10)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    check(N.nearest(df, df.where("vec_id % 20 = 0")).collect(), brute(vectors))


def test_few_and_none(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.nearest(none, none).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert N.nearest(one, one).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in N.nearest(two, two).orderBy("query_id").collect()] == [(0, 1, 1, 2.0), (1, 1, 0, 2.0)]


def test_the_stopping_test_stops():
    """On vectors with few directions most leaves are never opened."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20_000, 3)) @ rng.standard_normal((3, 24))
    norm = float(np.sqrt((x * x).sum(axis=1)).max())
    b = N.Block(np.arange(len(x)), x, norm)
    best, _, verified = b.search(np.arange(40), x[:40], 20)
    assert verified < 0.6 * 40 * len(x)
    s = x[:40] @ x.T
    s[np.arange(40), np.arange(40)] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(w)) for a, w in zip(best, want, strict=True)]) >= 18


def test_chi_square():
    assert N.chi2_cdf(np.array([0.0, 15.507, 1e6])).tolist() == pytest.approx([0, 0.95, 1], abs=1e-4)


def test_vectors_without_structure():
    """Where all are about as far from each other, under half of the pairs are verified, and
    nine in ten of the nearest are found."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((10_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    b = N.Block(np.arange(len(x)), x, 1.0)
    best, _, verified = b.search(np.arange(200), x[:200], 20)
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    assert verified < 0.5 * 200 * len(x)
    assert np.mean([len(set(a) & set(w)) for a, w in zip(best, want, strict=True)]) >= 18


def test_copies_score_alike():
    """Equal vectors have equal scores wherever they lie, so ties go by id."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 384))
    x[rng.permutation(3000)[:600]] = x[0]
    b = N.Block(np.arange(3000), x, float(np.sqrt((x * x).sum(axis=1)).max()))
    (best,), (score,), _ = b.search(np.array([-1]), x[:1], 400)
    assert len(set(score.tolist())) == 1 and best.tolist() == sorted(best.tolist())
    assert best.tolist() == np.flatnonzero((x == x[0]).all(axis=1))[:400].tolist()


def test_blocks_are_kept_and_read_back():
    rng = np.random.default_rng(6)
    b = N.Block(np.arange(500), rng.standard_normal((500, 8)), 9.0)
    c = N.Block.loaded(b.saved())
    assert all(np.array_equal(getattr(b, k), getattr(c, k)) for k in b.FIELDS)


def test_huge_components(spark):
    df = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1e38, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in N.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 3, 2e38), (20, 2, 1, 4.0)]
