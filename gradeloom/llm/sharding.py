"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks in them and shards in these.  At each level a row draws
-ln(u) / W for every child from a hash of its key and the child's name, W being the child's
weight, and goes down to the child with the least draw: first a region, then a rack of it,
then a shard of that.  A child is chosen with a chance in proportion to its weight, and a
change of weights moves rows only into or out of the subtrees whose weights change.  A grown
tree's new shards open regions of their own, so they take rows only into themselves and no
row moves between old ones.

Everything is column expressions; a row costs a hash for each region, and for each rack and
shard of the largest region and rack.

Cases: a null key is a key of its own.  Rows with equal keys share a shard (law ``key``).
Slots number a shard's rows from 0 by key hash, then doc_id, size and checksum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import written

#: Shards of a rack, and racks of a region.
RACK = 4
REGION = 2
#: Rows of one task's part of a shard, about, and the parts that equal rows go to.
PART_ROWS = 20_000
SALTS = 1024

Tree = list[list[list[float]]]


def tree(weights: list[float]) -> Tree:
    """Regions of racks of shards' weights."""
    racks = [weights[k : k + RACK] for k in range(0, len(weights), RACK)]
    return [racks[k : k + REGION] for k in range(0, len(racks), REGION)]


def _draw(key: Column, name: list[Column], weight: Column) -> Column:
    # 53 bits of the hash, never 0; what has no weight draws nothing
    u = (F.shiftrightunsigned(F.xxhash64(*name, key), 11).cast("double") + 0.5) / float(2**53)
    return F.when(weight > 0, -F.log(u) / weight)


def _least(draws: list[Column]) -> Column:
    """The place of the least draw, from 0."""
    all_ = F.array(*draws)
    return (F.array_position(all_, F.array_min(all_)) - 1).cast("int")


def _table(rows: list) -> Column:
    return F.array(*[_table(r) if isinstance(r, list) else F.lit(float(r)) for r in rows])


def place(docs: DataFrame, key: str, weights: list[float], name: str = "shard", more: list[float] | None = None) -> DataFrame:
    """``docs`` with column ``name``, its shard; with ``more``, the weights of a grown tree (the
    old ones first), also ``grown_`` + name."""
    if more and more[: len(weights)] != weights:
        raise ValueError("a grown tree keeps its old shards' weights")
    k, regions = F.col(key), tree(weights)
    trees = {name: regions} | ({f"grown_{name}": [*regions, *tree(more[len(weights) :])]} if more else {})
    for out, own in trees.items():
        widest, longest = max(len(r) for r in own), max(len(x) for r in own for x in r)
        weights = [[[*x, *[0.0] * (longest - len(x))] for x in r] + [[0.0] * longest] * (widest - len(r)) for r in own]
        of_racks = _table([[sum(x) for x in r] for r in weights])
        of_shards = _table(weights)
        docs = docs.withColumn("_region", _least([_draw(k, [F.lit("region"), F.lit(i)], F.lit(float(sum(map(sum, r))))) for i, r in enumerate(own)]))
        docs = docs.withColumn("_rack", _least([_draw(k, [F.lit("rack"), F.col("_region"), F.lit(j)], of_racks[F.col("_region")][j]) for j in range(widest)]))
        leaf = of_shards[F.col("_region")][F.col("_rack")]
        docs = docs.withColumn("_leaf", _least([_draw(k, [F.lit("shard"), F.col("_region"), F.col("_rack"), F.lit(i)], leaf[i]) for i in range(longest)]))
        numbers, at = [], 0
        for r in own:
            numbers.append([])
            for x in r:
                numbers[-1].append(at)
                at += len(x)
            numbers[-1] += [0] * (widest - len(r))
        docs = docs.withColumn(out, (_table(numbers)[F.col("_region")][F.col("_rack")] + F.col("_leaf")).cast("int")).drop("_region", "_rack", "_leaf")
    return docs


def slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """``rows`` with slot, from 0 without gaps in each shard.  A shard is numbered in parts of
    about ``PART_ROWS`` rows by a hash of ``order`` and of where a row lies, each offset by the
    parts before it: no task needs a whole shard, nor all rows that are equal."""
    rows = written(rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    per = rows.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-per // PART_ROWS))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*order, "_salt"), F.lit(parts)))
    within = Window.partitionBy(shard, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    counts = rows.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(shard).alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_slot", F.row_number().over(within).cast("long") - 1)
    joined = numbered.join(counts, (F.col(shard) == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("slot", F.col("_slot") + F.col("_before")).drop("_s", "_p", "_part", "_before", "_slot", "_salt")


def shard(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of ``docs`` (doc_id, text), and grown_shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return slots(place(rows, "doc_id", weights, more=grown), "shard", ["doc_id", "size", "text_crc32"])
