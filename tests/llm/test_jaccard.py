from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import jaccard as J
from gradeloom.llm.components import components
from gradeloom.llm.queries import op3_jaccard


def brute(rows, n, num, den):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    lists, links = defaultdict(list), set()
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in lists[x])
        for x in s:
            lists[x].append(i)
        for j, c in both.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                up[top(i)] = top(j)
                links.add((j, i))
    groups = defaultdict(list)
    for i, (doc_id, *_) in enumerate(rows):
        groups[top(i)].append(doc_id)
    name = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], len(s), name[top(i)]) for i, s in enumerate(sets)), key=str), links


def family(rng, size, words, edits, start):
    """Near copies of one text, some by way of others."""
    base = [f"f{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for k in range(size):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        if rng.random() < 0.2:
            base = text
        out.append((start + k, " ".join(text), None, None, None))
    return out


def check(spark, rows, n=4, num=85, den=100):
    df = spark.createDataFrame([(d, t) for d, t, *_ in rows], "doc_id long, text string").repartition(4)
    found, links = J.similar(df, n, num, den)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()), key=str)
    want, _ = brute(rows, n, num, den)
    assert got == want
    return links


def test_query(spark, folder, rows):
    got = sorted((tuple(r) for r in op3_jaccard(spark, folder).collect()), key=str)
    assert got == brute(rows, 4, 85, 100)[0]


@pytest.mark.parametrize("seed", range(3))
def test_families(spark, seed):
    """Sets of all sizes about the boundary, with chains that few edits make."""
    rng = random.Random(seed)
    rows, at = [], 0
    for words, edits, size in ((5, 1, 30), (9, 1, 40), (14, 1, 40), (20, 1, 40), (40, 2, 40), (200, 9, 60), (400, 20, 40)):
        rows += family(rng, size, words, edits, at)
        at += size
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(at + k, passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 120))), None, None, None) for k in range(60)]
    check(spark, rows)
    check(spark, rows, 5, 80, 100)


def test_long_lists_and_tiles(spark, monkeypatch):
    """A group larger than a list's and a block's bounds loses no link."""
    monkeypatch.setattr(J, "LIST", 8)
    monkeypatch.setattr(J, "TILE", 16)
    rng = random.Random(9)
    rows = family(rng, 150, 120, 6, 0) + family(rng, 80, 30, 2, 1000)
    check(spark, rows)


@pytest.mark.parametrize("rows", [50, 100, 150, 10_000])
def test_lists_go_on_in_the_next_batch(monkeypatch, rows):
    """Whatever the batches, members of a list that may be similar stay connected: also those
    of a long list of which a few come in a batch that ends in another long list."""
    monkeypatch.setattr(J, "LIST", 8)
    t = J.Threshold(85, 100)
    rng = random.Random(rows)
    for _ in range(20):
        members, node = [], 0
        for key in range(12):
            for _ in range(rng.choice([3, 30, 70, 103, 104, 180])):
                n = rng.randrange(90, 110)
                members.append((key, n, node, rng.randrange(int(t.prefix(n)))))
                node += 1
        members.sort()
        columns = [np.array(c, d) for c, d in zip(zip(*[(k, m, n, p) for k, n, m, p in members]), (np.int64, np.int64, np.int32, np.int32))]
        batches = [pa.RecordBatch.from_arrays([pa.array(c[at : at + rows]) for c in columns], schema=J.POSTING) for at in range(0, len(members), rows)]
        up = list(range(node))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for out in J._lists(t)(iter(batches)):
            for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                up[top(a)] = top(b)
        for i, (k, n, a, p) in enumerate(members):
            for k2, m, b, q in members[i + 1 :]:
                if k2 != k:
                    break
                if m <= t.largest(n) and min(n - p, m - q) >= t.both(n, m):
                    assert top(a) == top(b), (k, a, b)


def test_links_are_links(spark, rows):
    links = check(spark, rows, 5, 80, 100)
    assert links.count() >= 1


def test_empty(spark, no_docs):
    found, links = J.similar(no_docs)
    assert found.count() == 0 and links.count() == 0
    assert J.keep_one(no_docs).count() == 0


def test_keep_one(spark, docs, rows):
    got = J.keep_one(docs)
    assert got.columns == docs.columns
    ids = Counter(r["doc_id"] for r in got.collect())
    want = Counter()
    empty = [d for d, t, *_ in rows if not (t or "").split()]
    for d, n, c in brute(rows, 5, 80, 100)[0]:
        if n and d == c:
            want[d] = 1
    want.update(empty)
    want[None] = 1
    assert ids == want


def test_light_sets_share_a_subset():
    t = J.Threshold(85, 100)
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(6, 20)
        a = set(rng.sample(range(10**6), n))
        b = set(a)
        for _ in range(rng.randrange(3)):
            b.discard(rng.choice(sorted(b)))
        for _ in range(rng.randrange(3)):
            b.add(rng.randrange(10**6))
        if 100 * len(a & b) >= 85 * len(a | b):
            keys = [set(J.subset_keys(np.sort(J.mixed(np.array(sorted(s), np.uint64))), t).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]


def test_boundary_goes_with_cost():
    t = J.Threshold(85, 100)
    assert J.boundary({10: 1000}, t, 100.0) >= 10  # subsets are cheaper than long lists
    assert J.boundary({30: 1000}, t, 1.0) < 30


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_components(spark, few):
    chain = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 50)]
    got = components(spark.createDataFrame(chain, "a long, b long"), few).groupBy("component").agg(F.collect_set("node").alias("n")).collect()
    assert sorted(sorted(r["n"]) for r in got) == [list(range(301)), list(range(1000, 1050))]


def test_a_passage_brings_no_documents_together(spark, monkeypatch):
    """Documents that share a passage, more than a list's bound, aren't one group to be compared
    all with all."""
    monkeypatch.setattr(J, "LIST", 8)
    monkeypatch.setattr(J, "TILE", 16)

    def large(*_):
        raise AssertionError("a group of documents that a passage has brought together")

    monkeypatch.setattr(J, "large_links", large)
    rng = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(k, passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(40)), None, None, None) for k in range(60)]
    rows += family(rng, 6, 110, 1, 100)
    check(spark, rows)


def some_sets(rng, count):
    """Sets of about 10 to 3000, near ones among them."""
    out = []
    while len(out) < count:
        base = [rng.getrandbits(64) for _ in range(rng.choice([10, 50, 90, 100, 110, 400, 900, 3000]))]
        for _ in range(rng.randrange(1, 6)):
            own = set(base[: len(base) - rng.randrange(1 + len(base) // 6)]) | {rng.getrandbits(64) for _ in range(rng.randrange(1 + len(base) // 10))}
            out.append(np.sort(np.array(sorted(own), np.uint64)))
    return out[:count]


def test_sketches_differ_by_no_more_than_their_sets():
    rng = random.Random(3)
    sets = some_sets(rng, 60)
    marks = [J.sketch(s) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            size = min(len(marks[i]), len(marks[j]))
            apart = int(np.bitwise_count(J.folded(marks[i], size) ^ J.folded(marks[j], size)).sum())
            assert apart <= len(np.setxor1d(a, b))
            if not len(np.intersect1d(a, b)) and 80 * max(len(a), len(b)) <= 100 * min(len(a), len(b)):
                assert apart > J.Threshold(80, 100).apart(len(a), len(b))


@pytest.mark.parametrize(("cells", "long", "rows"), [(10**6, 2**17, 1000), (300, 2**17, 7), (300, 50, 7), (300, 50, 1000)])
def test_lists_by_sketches(monkeypatch, cells, long, rows):
    """Whatever the batches and bounds, similar members of a list stay connected."""
    monkeypatch.setattr(J, "LONG", long)
    monkeypatch.setattr(J.linked_by_sketch, "__defaults__", (cells,))
    t, rng = J.Threshold(80, 100), random.Random(rows + cells)
    sets = some_sets(rng, 150)
    short = [J.folded(J.sketch(s), J.DENSE // 8).tobytes() for s in sets]
    members = sorted((key, len(sets[k]), k) for key, part in enumerate((range(3), range(3, 140), range(100, 150))) for k in part)
    table = pa.table({"key": pa.array([m[0] for m in members], pa.int64()), "node": pa.array([m[2] for m in members], pa.int64()), "n": pa.array([m[1] for m in members], pa.int32()), "place": pa.array([0] * len(members), pa.int32()), "sketch": [short[m[2]] for m in members]})
    forest = J._Forest(len(sets))
    links = 0
    for out in J._dense(t)(iter(table.to_batches(rows))):
        links += out.num_rows
        for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            forest.join(a, b)
    for key, _, a in members:
        for other, _, b in members:
            if key == other and a < b and 100 * len(both := np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - len(both)):
                assert forest.top(a) == forest.top(b)
    if long > 1000:  # sets that have nothing in common are apart, but for those too large for so few bits
        groups = Counter(forest.top(k) for k in range(len(sets)) if len(sets[k]) < 1200)
        assert max(groups.values()) <= 5


def test_keep_one_of_documents_that_share_a_passage(spark, monkeypatch):
    """As above, with the pipeline's words and threshold."""
    monkeypatch.setattr(J, "LIST", 8)
    monkeypatch.setattr(J, "TILE", 16)

    def large(*_):
        raise AssertionError("a group of documents that a passage has brought together")

    monkeypatch.setattr(J, "large_links", large)
    rng = random.Random(13)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(k, passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(50))) for k in range(60)]
    rows += [(100 + k, text + " more") for k, text in rows[:5]]
    got = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(60))
