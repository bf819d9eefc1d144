"""Connected components of a link table, by contraction.

Each round every node joins its least neighbour (or itself) in an order that a hash draws anew
for the round, links are carried over to what their ends joined, and loops and repeats go.  A
round leaves a third or so of a chain's nodes, and a star is gone in two.  Once no more than
``FEW`` links are left, whatever their number was, one task joins these.  Nothing is collected
to the driver but a count of links a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import written

#: Links, in both directions, that one task ends with: 2 MB.
FEW = 2**17


def _ended(batches):
    """node and to, a name of its component, of all nodes of these links."""
    ends = [np.concatenate(x) for x in zip(*((b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches), strict=True)]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    up = list(range(len(nodes)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(*(x.tolist() for x in np.split(at, 2)), strict=True):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    to = nodes[[top(x) for x in range(len(nodes))]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(to)], names=["node", "to"])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """node and component (the same for all nodes that ``links``, columns a and b, connect) of
    every node with a link."""
    once = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(once.select(F.explode(both).alias("e")).select("e.a", "e.b"))
    steps: list[DataFrame] = []
    while left := edges.count():
        if left <= few:
            steps.append(written(edges.coalesce(1).mapInArrow(_ended, "node long, to long")))
            break
        drawn = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        least = edges.groupBy("a").agg(F.min(drawn("b")).alias("b")).select(F.col("a").alias("node"), F.least(drawn("a"), F.col("b"))["id"].alias("to"))
        step = written(least)
        steps.append(step)
        moved = edges.join(step, F.col("a") == F.col("node")).select(F.col("to").alias("a"), "b")
        moved = moved.join(step, F.col("b") == F.col("node")).select("a", F.col("to").alias("b"))
        edges = written(moved.where(F.col("a") != F.col("b")).distinct())
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    out = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        later = step.select(F.col("node").alias("_from"), F.col("to").alias("_to"))
        out = out.join(later, F.col("component") == F.col("_from"), "left").select("node", F.coalesce("_to", "component").alias("component"))
    return written(out)
