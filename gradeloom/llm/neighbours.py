"""Approximate nearest neighbours by inner product: low-dimensional stable projections in a
kd-tree.

Vectors are lifted by one component so that all have the greatest norm M; then the nearest by
Euclid are the largest inner products.  They are projected to ``M_DIM`` dimensions by Gaussian
(2-stable) weights.  The top of the kd-tree, fitted on a sample of about ``SAMPLE`` rows, deals
all rows to blocks; each block's own tree is built once and written to the shared folder.  A
query goes to its home block first, and then to the blocks, leaves and vectors there in the
order of their projected distance, until a chi-square test holds: with squared distance d of
its k-th best so far, one nearer would by now have shown itself with probability
``CONFIDENCE``, as its projected distance, squared and over d, follows chi-square.  Only what
passes that test is verified, by the exact inner product.

All rows are indexed.  Of equal vectors only the k + 1 with the least ids are candidates: no
other can be among k nearest when ties go to the smaller id.  Inner products are summed in one
order, so equal vectors score alike.  What travels are queries, not the index.

Cases: vectors null, empty, zero or with null or non-finite components take no part, neither
does a null id, nor one so long that its squared norm is no finite number.  Vectors of
different lengths don't meet.  Rows repeated whole count once.  With fewer than k candidates
all are returned.  No rows: no rows.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import file_system, shared_dir, write_file, written

M_DIM = 32
CONFIDENCE = 0.9
LEAF = 64
#: Vectors of a block, as long as there are no more than so many blocks; queries that meet a
#: block in a task; rows that the top of the tree is fitted on.
INDEX_ROWS, MOST_BLOCKS = 32_768, 20_000
QUERY_ROWS = 512
SAMPLE = 32_768
SEED = 16


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0) & (norm2(v) < F.lit(float("inf"))), F.lit(False))


def norm2(v: Column) -> Column:
    return F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)


def chi2_cdf(x: np.ndarray, m: int = 8) -> np.ndarray:
    """For an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def radius(confidence: float, m: int = M_DIM) -> float:
    """The quantile of chi-square, by bisection."""
    low, high = 0.0, 100.0 * m
    for _ in range(100):
        middle = (low + high) / 2
        if chi2_cdf(np.array(middle), m) < confidence:
            low = middle
        else:
            high = middle
    return high


RADIUS = radius(CONFIDENCE)


def projected(vectors: np.ndarray, norm: float, lifted: bool = True) -> np.ndarray:
    """Vectors over the norm, lifted to length 1, and projected; queries are scaled to length 1,
    not lifted."""
    weights = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, M_DIM))
    if not lifted:
        return (vectors / lengths(vectors)[:, None]) @ weights[:-1]
    vectors = vectors / norm
    return vectors @ weights[:-1] + np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", vectors, vectors)))[:, None] * weights[-1]


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def halved(points: np.ndarray, rows: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Rows cut in two halves along the widest side of their points."""
    own = points[rows]
    side = int(np.argmax(np.ptp(own, axis=0)))
    order = np.argpartition(own[:, side], len(rows) // 2)
    left, right = rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]
    return side, float(points[right, side].min()), left, right


class Top:
    """The top of a kd-tree: which block a point belongs to."""

    def __init__(self, points: np.ndarray, blocks: int):
        self.nodes: list[tuple] = []
        self.blocks = 0
        self._grow(points, np.arange(len(points)), blocks)

    def _grow(self, points: np.ndarray, rows: np.ndarray, blocks: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if blocks > 1 and len(rows) > 1:
            side, cut, left, right = halved(points, rows)
            self.nodes[at] = (side, cut, self._grow(points, left, blocks // 2), self._grow(points, right, blocks - blocks // 2))
        else:
            self.nodes[at] = (-1, self.blocks, 0, 0)
            self.blocks += 1
        return at

    def block_of(self, points: np.ndarray) -> np.ndarray:
        side, cut, left, right = (np.array(x) for x in zip(*self.nodes, strict=True))
        at = np.zeros(len(points), np.int64)
        while len(inner := np.flatnonzero(side[at] >= 0)):
            node = at[inner]
            at[inner] = np.where(points[inner, side[node]] < cut[node], left[node], right[node])
        return cut[at].astype(np.int64)


class Block:
    """A kd-tree over the projections of some vectors, in ascending order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.norm = ids[order], np.ascontiguousarray(vectors[order]), norm
        points = projected(self.vectors, norm)
        leaves, open_ = [], [np.arange(len(points))]
        while open_:  # halves until a leaf is small; equal points are halved too
            rows = open_.pop()
            if len(rows) <= LEAF:
                leaves.append(np.sort(rows))
            else:
                open_ += halved(points, rows)[2:]
        self.rows, self.starts = np.concatenate(leaves), np.cumsum([0, *map(len, leaves)])
        self.points = points[self.rows].astype(np.float32)
        self.low = np.minimum.reduceat(self.points, self.starts[:-1])
        self.high = np.maximum.reduceat(self.points, self.starts[:-1])

    FIELDS = ("ids", "vectors", "norm", "rows", "starts", "points", "low", "high")

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Block:
        block = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as f:
            for k in cls.FIELDS:
                setattr(block, k, f[k])
        block.norm = float(block.norm)
        return block

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """For each query the positions and scores of its k best, and how many were verified.
        ``known``: the score that a query's k-th best elsewhere has."""
        scale = lengths(queries)
        q = projected(queries, self.norm, lifted=False).astype(np.float32)
        bound = bounds(q, self.low, self.high)
        order = np.argsort(bound, axis=1, kind="stable")
        n, leaves = bound.shape
        least = np.full(n, -np.inf) if known is None else known.astype(float)
        who, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q2, p2 = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", self.points, self.points)
        active, seen, step, verified = np.arange(n), 0, max(1, -(-2 * k // LEAF)), 0
        while len(active) and seen < leaves:
            step = min(step, leaves - seen)
            now = order[active, seen : seen + step]
            reach = reach_of(least, scale, self.norm)
            found = [(who, row, score)]
            by = np.argsort(now, axis=None, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(now.ravel()[by])) + 1):
                leaf = int(now.ravel()[part[0]])
                s, e = int(self.starts[leaf]), int(self.starts[leaf + 1])
                asking = active[part // step]
                far = q2[asking, None] + p2[None, s:e] - 2 * (q[asking] @ self.points[s:e].T)
                a, p = np.nonzero(far <= reach[asking, None])
                a, p = asking[a], self.rows[s + p]
                verified += len(a)
                # one order of summation for every pair
                found.append((a, p, (queries[a] * self.vectors[p]).sum(axis=1)))
            who, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
            # the k best, ties to the smaller id: rows are numbered by id
            mine = np.flatnonzero(self.ids[row] != ids[who])
            mine = mine[np.lexsort((row[mine], -score[mine], who[mine]))]
            first = np.searchsorted(who[mine], np.arange(n))
            mine = mine[np.arange(len(mine)) - first[who[mine]] < k]
            who, row, score = who[mine], row[mine], score[mine]
            full = np.flatnonzero(np.bincount(who, minlength=n) == k)
            least[full] = np.maximum(least[full], score[np.searchsorted(who, full, "right") - 1])
            seen += step
            if seen < leaves:
                active = active[bound[active, order[active, seen]] <= reach_of(least, scale, self.norm)[active]]
            step = seen
        at = np.searchsorted(who, np.arange(n + 1))
        return [row[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], [score[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], verified


def reach_of(least: np.ndarray, length: np.ndarray, norm: float) -> np.ndarray:
    """The squared projected distance beyond which the chi-square test holds, from the score of
    the k-th best and the queries' lengths; what rounding may hide is within."""
    known = np.isfinite(least)
    d = np.maximum(0.0, 2 - 2 * (np.where(known, least, 0) / length) / norm)
    return np.where(known, RADIUS * d + 1e-4, np.inf)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes."""
    out = np.zeros((len(q), len(low)), np.float32)
    for j in range(q.shape[1]):
        gap = np.maximum(0, np.maximum(low[None, :, j] - q[:, None, j], q[:, None, j] - high[None, :, j]))
        out += gap * gap
    return out


def _stacked(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: of ``vectors`` (vec_id, embedding) the k nearest to
    each of ``queries`` (vec_id, embedding) but those with the query's own id."""
    spark = vectors.sparkSession
    path = shared_dir(spark)
    keep = lambda df: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim")).dropDuplicates(["vec_id", "embedding"])
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    index = written(keep(vectors).withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).drop("_copy"))
    asked = written(keep(queries))
    # a row for each length of vectors
    stats = {r["dim"]: (r["n"], math.sqrt(r["most"])) for r in index.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm2(F.col("embedding"))).alias("most")).collect()}
    norms = {d: m for d, (_, m) in stats.items()}

    def by_length(part: pa.RecordBatch):
        dims = part.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            if d in norms:
                yield d, part.filter(pa.array(dims == d))

    def sampled(batches):
        for b in batches:
            for d, own in by_length(b):
                points = projected(_stacked(own.column("embedding")), norms[d]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([points.tobytes()], pa.binary())], names=["dim", "points"])

    tops: dict[int, Top] = {}
    for d, (n, _) in stats.items():
        blocks = -(-n // max(INDEX_ROWS, -(-n // MOST_BLOCKS)))
        points = np.zeros((0, M_DIM), np.float32)
        if blocks > 1:
            some = index.where((F.col("dim") == d) & (F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(max(1, n // SAMPLE))) == 0))
            points = np.concatenate([np.frombuffer(r["points"], np.float32) for r in some.mapInArrow(sampled, "dim int, points binary").collect()] or [points.ravel()]).reshape(-1, M_DIM)
            points = points[np.lexsort(points.T)]
        tops[d] = Top(points, blocks)

    def dealt(lifted: bool):
        def run(batches):
            for b in batches:
                for d, own in by_length(b):
                    points = projected(_stacked(own.column("embedding")), norms[d], lifted).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(tops[d].block_of(points))], names=[*own.schema.names, "block"])

        return run

    names = "vec_id long, embedding array<double>, dim int, block long"

    def built(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        d, number = (int(x) for x in key)
        block = Block(part["vec_id"].to_numpy(), np.stack(part["embedding"].to_numpy()), norms[d])
        write_file(f"{path}/block-{d}-{number}.npz", block.saved())
        return pd.DataFrame({"dim": [d], "block": [number], "low": [block.low.min(axis=0).tolist()], "high": [block.high.max(axis=0).tolist()]})

    boxes = index.mapInArrow(dealt(True), names).groupBy("dim", "block").applyInPandas(built, "dim int, block long, low array<float>, high array<float>")
    boxes = {d: own.sort_values("block") for d, own in written(boxes).toPandas().groupby("dim")}  # MOST_BLOCKS and one a length at most

    def met(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        files, name = file_system(f"{path}/block-{int(key[0])}-{int(key[1])}.npz")
        if files.get_file_info(name).type.name != "File":  # a block without a row
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        with files.open_input_file(name) as f:
            block = Block.loaded(f.read())
        out = []
        for at in range(0, len(part), QUERY_ROWS):
            own = part.iloc[at : at + QUERY_ROWS]
            ids = own["vec_id"].to_numpy()
            best, score, _ = block.search(ids, np.stack(own["embedding"].to_numpy()), k, own["known"].to_numpy(float))
            out.append(pd.DataFrame({"query_id": np.repeat(ids, [len(b) for b in best]), "vec_id": block.ids[np.concatenate(best)], "score": np.concatenate(score)}))
        return pd.concat(out)

    def search(pairs: DataFrame) -> DataFrame:
        """Pairs (vec_id, embedding, dim, block, known); a block's queries are dealt in groups."""
        pairs = written(pairs)
        groups = pairs.groupBy("dim", "block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("groups"))
        pairs = pairs.join(groups, ["dim", "block"]).withColumn("group", F.pmod(F.xxhash64("vec_id"), "groups"))
        return written(pairs.groupBy("dim", "block", "group").applyInPandas(met, "query_id long, vec_id long, score double"))

    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    found = search(asked.mapInArrow(dealt(False), names).withColumn("known", F.lit(float("-inf"))))
    if any(len(own) > 1 for own in boxes.values()):
        last = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        last = last.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least")).alias("known"))

        def others(batches):
            for b in batches:
                for d, own in by_length(b):
                    if not len(box := boxes.get(d, ())):
                        continue
                    v = _stacked(own.column("embedding"))
                    points = projected(v, norms[d], lifted=False).astype(np.float32)
                    known = own.column("known").fill_null(-np.inf).to_numpy()
                    reach = reach_of(known, lengths(v), norms[d])
                    far = bounds(points, *(np.stack(box[c].to_numpy()).astype(np.float32) for c in ("low", "high")))
                    at, number = np.nonzero(far <= reach[:, None])
                    block = box["block"].to_numpy()[number]
                    other = block != tops[d].block_of(points)[at]
                    taken = own.select(["vec_id", "embedding", "dim"]).take(pa.array(at[other]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block[other].astype(np.int64)), pa.array(known[at[other]])], names=["vec_id", "embedding", "dim", "block", "known"])

        found = found.unionByName(search(asked.join(last, "vec_id", "left").mapInArrow(others, names + ", known double")))
    return ranked(found.dropDuplicates(["query_id", "vec_id", "score"])).select("query_id", "rank", "vec_id", "score")
