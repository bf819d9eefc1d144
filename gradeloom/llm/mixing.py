"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents are laid out, in a seeded order, over shards and each shard is cut
into blocks of equal tokens: ``block`` words, or in a small source a ``PARTS``-th of it, so
that every source's words can come near its target.  Blocks are allocated to sources by
highest quotients target / (words of the source's seats + half a block), and a source's
blocks to its shards in the same way, so each shard has an integer quota.  A shard takes all
its blocks quota // blocks times and a seeded choice of them once more.  A document is taken
as often as the blocks that cover it.

The driver holds a few numbers a source; a source's shards, ``MOST_SHARDS`` at most of all
sources and one each at least, get their quotas in a task.  Only numbers are shuffled unless
the caller's frame carries texts.

Cases: a null text has size 0 and is never taken.  A null source is a source, ordered last.
No rows, or no words at all: targets and taken are 0.  Rows that repeat count each time.
Rows with a size of 0 stay in the result with 0 taken.  What a source's words can miss its
target by is about a block of its own.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.shared import n_words, trim, written

#: Words of a shard, as long as that makes no more than so many shards.
SHARD_WORDS = 250_000
SHARD_ROWS = 500_000
MOST_SHARDS = 1_000_000
#: Blocks of a source at least, as long as they have a word each.
PARTS = 64
#: A source with more rows than this many is not joined by broadcast.
BROADCAST_SOURCES = 20_000
SEED = 20_240_229


def targets(sizes: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """Shares of all sizes by weight, none above ``most`` times its size; the excess goes to
    the others by weight until none is above."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    target = np.zeros(len(sizes))
    free = np.ones(len(sizes), bool)
    left = sizes.sum()
    while free.any():
        share = left * weights[free] / weights[free].sum()
        over = share > most * sizes[free]
        if not over.any():
            target[free] = share
            break
        k = np.flatnonzero(free)[over]
        target[k] = most * sizes[k]
        left = sizes.sum() - target[~free].sum() - target[k].sum()
        free[k] = False
    return target


def apportion(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: seats by the highest quotients weight / (own seats + 1/2), ties to the
    first, none above ``most``.  A divisor search finds what seat-by-seat dealing would."""
    weights, most = np.asarray(weights, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[weights > 0].sum()))
    if seats <= 0:
        return np.zeros(len(weights), np.int64)

    def given(divisor: float) -> np.ndarray:
        return np.where(weights > 0, np.minimum(np.floor(np.minimum(weights / divisor + 0.5, 9e17)).astype(np.int64), most), 0)

    low, high = 1e-12, 2 * weights.max() + 1
    for _ in range(200):
        middle = (low + high) / 2 if low > high / 4 else math.sqrt(low * high)
        if given(middle).sum() > seats:
            low = middle
        else:
            high = middle
        if high - low <= 1e-15 * high:
            break
    out = given(high)
    left = seats - int(out.sum())
    while left > 0:
        quotient = np.where((out < most) & (weights > 0), weights / (out + 0.5), -1)
        k = np.lexsort((np.arange(len(out)), -quotient))[:left]
        k = k[quotient[k] > 0]
        out[k] += 1
        left -= len(k)
        if not len(k):
            break
    return out


def allocate(target: np.ndarray, length: np.ndarray, words: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Laguë where a seat of source k carries ``length[k]`` words: seats by the highest
    quotients target / (length * (own seats + 1/2)), ties to the first, until no source's seat
    fits into ``words``; none has more than ``most``."""
    target, length, most = np.asarray(target, float), np.asarray(length, float), np.asarray(most, np.int64)
    weights = np.where(most > 0, target / length, 0)
    if words <= 0 or not (weights > 0).any():
        return np.zeros(len(weights), np.int64)

    def given(divisor: float) -> np.ndarray:
        return np.where(weights > 0, np.minimum(np.floor(np.minimum(weights / divisor + 0.5, 9e15)).astype(np.int64), most), 0)

    low, high = 1e-12, 2 * weights.max() + 1
    for _ in range(200):
        middle = (low + high) / 2 if low > high / 4 else math.sqrt(low * high)
        if (given(middle) * length).sum() > words:
            low = middle
        else:
            high = middle
        if high - low <= 1e-15 * high:
            break
    out = given(high)
    left = words - (out * length).sum()
    # what the next quotients would be dealt: a seat each at most, as equal quotients are all that is left
    quotient = np.where((out < most) & (weights > 0), weights / (out + 0.5), -1)
    for k in np.lexsort((np.arange(len(out)), -quotient)).tolist():
        if left <= 0 or quotient[k] <= 0:
            break
        if length[k] <= left:
            out[k] += 1
            left -= length[k]
    return out


def taken(sizes: np.ndarray, quota: int, blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: words taken of each; the blocks' bounds and how often
    each block is taken."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    bounds = (np.arange(blocks + 1, dtype=object) * total // max(blocks, 1)).astype(np.int64) if total > 2**31 else np.arange(blocks + 1, dtype=np.int64) * total // max(blocks, 1)
    times = np.full(blocks, quota // max(blocks, 1), np.int64)
    if blocks and quota % blocks:
        times[np.random.default_rng(seed).permutation(blocks)[: quota % blocks]] += 1
    before = np.concatenate([[0], np.cumsum(times * np.diff(bounds))])

    def until(x: np.ndarray) -> np.ndarray:
        if not blocks:
            return np.zeros(len(x), np.int64)
        k = np.clip(np.searchsorted(bounds, x, "right") - 1, 0, blocks - 1)
        return before[k] + times[k] * (x - bounds[k])

    return until(ends) - until(ends - sizes), bounds, times


def mix(docs: DataFrame, cycle: tuple[float, ...] = (5, 2, 1), most: int = 3, block: int = 32, seed: int = SEED, spans: bool = False, counted: bool = False, texts: bool = False) -> DataFrame:
    """``docs`` (doc_id, source, text) with size, source_size, target and taken.  ``counted``:
    in place of text, docs has size and _key, what their seeded order goes by.

    Sources, by code point and null last, weigh ``cycle``, repeating.  With ``spans`` there
    is also an array of (start, end, times): words [start, end) are taken so many times.
    With ``texts`` the rows are the mix itself, as mixed_texts() has it.
    """
    columns = docs.columns
    spark = docs.sparkSession
    if not counted:
        docs = docs.withColumns({"size": n_words(F.col("text")), "_key": F.xxhash64(F.lit(seed), "doc_id", "text")})
    kept = written(docs)  # sizes are counted once
    per = kept.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    per.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes = np.array([r["size"] or 0 for r in per], np.int64)
    rows = np.array([r["n"] for r in per], np.int64)
    weights = np.array([cycle[k % len(cycle)] for k in range(len(per))], float)
    total = int(sizes.sum())
    target = targets(sizes, weights, most)
    words = max(SHARD_WORDS, math.ceil(total / MOST_SHARDS))
    shards = np.maximum(1, np.maximum(-(-sizes // words), -(-rows // SHARD_ROWS)))
    blocks = np.maximum(1, np.rint(sizes / np.clip(sizes // PARTS, 1, block))).astype(np.int64)
    length = np.maximum(sizes, 1) / blocks
    seats = allocate(target, length, total, np.where(sizes > 0, most * blocks, 0))
    names = spark.createDataFrame(
        [(r["source"], k, int(shards[k]), int(sizes[k]), float(target[k]), float(length[k]), int(seats[k])) for k, r in enumerate(per)],
        "_name string, _source int, _shards long, source_size long, target double, _length double, _seats long",
    )
    if len(per) <= BROADCAST_SOURCES:
        names = F.broadcast(names)
    placed = kept.join(names, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    # what has no words is never taken, wherever it lies
    placed = placed.withColumn("_shard", F.pmod(F.when(F.col("size") > 0, F.col("_key")).otherwise(F.xxhash64(F.monotonically_increasing_id())), "_shards"))

    def quotas(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_shard", ignore_index=True)
        size, each = own["size"].to_numpy(np.int64), own["_length"].iloc[0]
        blocks = np.where(size > 0, np.maximum(1, np.rint(size / each)), 0).astype(np.int64)
        quota = apportion(size, int(own["_seats"].iloc[0]), most * blocks)
        return pd.DataFrame({"_source": own["_source"], "_shard": own["_shard"], "_quota": quota, "_blocks": blocks})

    cells = placed.groupBy("_source", "_shard").agg(F.sum("size").alias("size"), F.first("_length").alias("_length"), F.first("_seats").alias("_seats"))
    plan = cells.groupBy("_source").applyInPandas(quotas, "_source int, _shard long, _quota long, _blocks long")

    schema = T.StructType([f for f in placed.schema if f.name not in ("_source", "_shard", "_shards", "_key", "_length", "_seats")])
    schema.add("taken", T.LongType())
    if spans:
        schema.add("spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "times")])))
    if texts:
        schema = T.StructType([placed.schema[c] for c in columns])
    names_out = schema.names
    spans = spans or texts

    def cell(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in names_out})
        left = left.sort_values(["_key", "doc_id", "size"], ignore_index=True, kind="stable")
        n = left["size"].to_numpy(np.int64)
        q, b = (int(right["_quota"].iloc[0]), int(right["_blocks"].iloc[0])) if len(right) else (0, 0)
        left["taken"], bounds, times = taken(n, q, b, [seed, int(key[0]), int(key[1])])
        if spans:
            ends = np.cumsum(n)
            found = []
            for start, end in zip((ends - n).tolist(), ends.tolist(), strict=True):
                own = []
                if b and end > start:
                    first, last = np.searchsorted(bounds, start, "right") - 1, np.searchsorted(bounds, end, "left")
                    for k in range(first, last):
                        s, e, t = max(start, int(bounds[k])) - start, min(end, int(bounds[k + 1])) - start, int(times[k])
                        if t and own and own[-1][1] == s and own[-1][2] == t:
                            own[-1] = (own[-1][0], e, t)
                        elif t and e > s:
                            own.append((s, e, t))
                found.append([dict(zip(("start", "end", "times"), x, strict=True)) for x in own])
            left["spans"] = found
        out = _texts(left, columns) if texts else left[names_out]
        if texts and random.random() < 0.1:  # what pandas leaves behind in a worker is mostly texts
            trim()
        return out

    return placed.groupBy("_source", "_shard").cogroup(plan.groupBy("_source", "_shard")).applyInPandas(cell, schema)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts(taken_: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    got = []
    for row in taken_.to_dict("records"):
        own = [(int(x["start"]), int(x["end"]), int(x["times"])) for x in row["spans"]]
        for time in range(max((t for *_, t in own), default=0)):
            runs: list[list[int]] = []
            for start, end, t in own:
                if t <= time:
                    continue
                if runs and runs[-1][1] == start:
                    runs[-1][1] = end
                else:
                    runs.append([start, end])
            text = row["text"]
            if runs != [[0, row["size"]]]:
                at = [m.span() for m in WORD.finditer(text)]
                text = "\n".join(text[at[s][0] : at[e - 1][1]] for s, e in runs)
            new = {c: row[c] for c in columns} | {"text": text}
            if "n_chars" in new and not pd.isna(new["n_chars"]):
                new["n_chars"] = len(text)
            got.append(new)
    return pd.DataFrame(got, columns=columns)


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each time that any words of a
    document are taken, its text cut to the words that this time covers (the whole text,
    byte for byte, where that is all of them).  Rows of which nothing is taken go."""
    return mix(docs, texts=True, **how)
