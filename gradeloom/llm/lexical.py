"""Ranked lexical search over a two-level quantised index.

``index`` tokenises each whole text once and writes blocks of documents.  A block's first
level has, for each of its terms, the documents that hold it and a byte each, the impact of
the term's occurrences rounded up to a multiple of ``STEP``; its second level has the exact
counts and lengths.  ``search`` takes the queries in blocks of bounded size, broadcasts one
at a time and passes over the index without a shuffle of it:

1. the first level's posting lengths give each query term's document frequency;
2. sums of bytes bound each document's score from both sides; the k-th largest lower bound
   of an item, over all tasks' k largest, is what a document must be able to reach;
3. each document whose upper bound reaches it is scored again from the second level, in
   64-bit integers, and each task hands on the k best of an item.

Scores are those of the contract of op13: terms are maximal runs of ASCII letters and digits
and of all characters beyond ASCII, with A-Z lower-cased.

Cases: a null or empty text, or one without a term, is no document and counts in nothing; an
item without a term finds nothing.  Equal scores go by ascending doc_id, null last.  A
repeated document is a document each time, and a repeated item a query of its own each
time.  No documents or no items: no rows.  A text of any length is one document: blocks end
after the document that fills them.  Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import batch, small_batches, tidy, written

#: Documents, and postings, that end a block.
DOCS, POSTINGS = 4096, 500_000
#: Impacts are below 1,000,000: a byte times this reaches each.
STEP = 3922
#: Bytes of queries that are broadcast at a time.
QUERIES = 8_000_000

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = "terms array<binary>, ends binary, docs binary, impacts binary, counts binary, spans binary, doc_ids array<long>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def span(n: int, docs: int, terms: int) -> int:
    """The m of a document of n terms."""
    return 25 + 75 * n * docs // terms


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def impact(counts: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Exact impacts of counts of a term in documents of these spans."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * spans)


def _texts(batches):
    for b in batches:
        yield from b.column("text").cast(pa.binary()).drop_null()


def _totals(batches):
    docs = terms = 0
    for text in _texts(batches):
        n = len(terms_of(text.as_py()))
        docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})


def _blocks(n_docs: int, n_terms: int, most: int, postings: int):
    schema = pa.schema([("terms", pa.list_(pa.binary()))] + [(c, pa.binary()) for c in ("ends", "docs", "impacts", "counts", "spans")] + [("doc_ids", pa.list_(pa.int64()))])

    def close(names: dict, of_term: list, counts: list, held: list, spans: list, doc_ids: list):
        of_term, counts = np.array(of_term), np.array(counts, np.int64)
        docs = np.repeat(np.arange(len(held)), held)
        order = np.argsort(of_term, kind="stable")
        docs, counts, spans = docs[order], counts[order], np.array(spans, np.int64)
        bytes_ = -(-impact(counts, spans[docs]) // STEP)
        ends = np.cumsum(np.bincount(of_term, minlength=len(names)))
        packed = [x.astype(t).tobytes() for x, t in ((ends, "<i8"), (docs, "<u2"), (bytes_, "u1"), (counts, "<u4"), (spans, "<i8"))]
        return batch(schema, [[list(names)], *([x] for x in packed), [doc_ids]])

    def run(batches):
        names, of_term, counts, held, spans, doc_ids = new = {}, [], [], [], [], []
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                if not text.is_valid or not (found := terms_of(text.as_py())):
                    continue
                each = Counter(found)
                of_term += [names.setdefault(t, len(names)) for t in each]
                counts += each.values()
                held.append(len(each))
                spans.append(span(len(found), n_docs, n_terms))
                doc_ids.append(doc_id)
                if len(held) >= most or len(of_term) >= postings:
                    yield close(*new)
                    for x in new:
                        x.clear()
        if held:
            yield close(*new)

    return run


class Index:
    """Blocks as a table in the shared folder, documents with a term, and their terms."""

    def __init__(self, blocks: DataFrame, docs: int, terms: int):
        self.blocks, self.docs, self.terms = blocks, docs, terms


def index(documents: DataFrame, most: int = DOCS, postings: int = POSTINGS) -> Index:
    """Index of all terms of ``documents`` (doc_id long, text string), in blocks of at most so
    many documents (65,536 at most) that end once they have so many postings."""
    rows = documents.select("doc_id", "text")
    spark = rows.sparkSession
    with small_batches(spark):
        total = rows.select("text").mapInArrow(tidy(_totals), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
        docs, terms = total[0] or 0, total[1] or 0
        return Index(written(rows.mapInArrow(tidy(_blocks(docs, max(terms, 1), most, postings)), INDEX)), docs, terms)


class _Block:
    """The query's terms in a block."""

    def __init__(self, row: dict, vocabulary: pa.Array):
        at = pc.index_in(vocabulary, value_set=row["terms"].values)
        self.at = at.fill_null(-1).to_numpy(zero_copy_only=False)
        self.ends = np.frombuffer(row["ends"].as_py(), "<i8")
        self.docs = np.frombuffer(row["docs"].as_py(), "<u2").astype(np.intp)
        self.impacts = np.frombuffer(row["impacts"].as_py(), "u1").astype(np.int64)
        self.size = int(self.docs.max()) + 1
        self.row = row

    def postings(self, ids: np.ndarray, weights: np.ndarray):
        """(slice, weight) of an item's terms that the block has."""
        for k, w in zip(self.at[ids].tolist(), weights.tolist(), strict=True):
            if k >= 0 and w:
                yield slice(self.ends[k - 1] if k else 0, self.ends[k]), w

    def bounds(self, ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of the block's documents."""
        total, share = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for s, w in self.postings(ids, weights):
            docs = self.docs[s]
            total[docs] += w * self.impacts[s]
            share[docs] += w
        return STEP * (total - share), STEP * total

    def scores(self, ids: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of the wanted documents, from the second level."""
        counts, spans = np.frombuffer(self.row["counts"].as_py(), "<u4"), np.frombuffer(self.row["spans"].as_py(), "<i8")
        chosen, total = np.zeros(self.size, bool), np.zeros(self.size, np.int64)
        chosen[wanted] = True
        for s, w in self.postings(ids, weights):
            docs, n = self.docs[s], counts[s].astype(np.int64)
            hit = chosen[docs]
            total[docs[hit]] += w * impact(n[hit], spans[docs[hit]])
        return total[wanted]


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):
            yield {c: b.column(c)[k] for c in b.schema.names}


def _held(vocabulary: list[bytes]):
    def run(batches):
        wanted, total = pa.array(vocabulary, pa.binary()), np.zeros(len(vocabulary), np.int64)
        for row in _rows(batches):
            at = pc.index_in(wanted, value_set=row["terms"].values).fill_null(-1).to_numpy(zero_copy_only=False)
            sizes = np.diff(np.frombuffer(row["ends"].as_py(), "<i8"), prepend=0)
            total[at >= 0] += sizes[at[at >= 0]]
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(k, pa.int64()), "held": pa.array(total[k], pa.int64())})

    return run


def _lower(query, k: int):
    """The k largest lower bounds of each item in a task."""

    def run(batches):
        vocabulary, items = query.value
        wanted, best = pa.array(vocabulary, pa.binary()), [np.zeros(0, np.int64)] * len(items)
        for row in _rows(batches):
            block = _Block(row, wanted)
            for i, (ids, weights) in enumerate(items):
                low = block.bounds(ids, weights)[0]
                low = low[low > 0]
                if len(best[i]) == k:
                    low = low[low > best[i].min()]
                if len(low):
                    best[i] = np.sort(np.concatenate([best[i], low]))[-k:]
        yield pa.RecordBatch.from_pydict(
            {"item": pa.array(np.repeat(np.arange(len(items)), [len(x) for x in best]), pa.int64()), "low": pa.array(np.concatenate([*best, np.zeros(0, np.int64)]), pa.int64())}
        )

    return run


def _exact(query, least, k: int):
    """The k best documents of each item in a task, of those that may be among the k best of all."""

    def run(batches):
        (vocabulary, items), reach = query.value, least.value
        wanted, best = pa.array(vocabulary, pa.binary()), [[] for _ in items]
        for row in _rows(batches):
            block, doc_ids = _Block(row, wanted), row["doc_ids"].as_py()
            for i, (ids, weights) in enumerate(items):
                may = np.flatnonzero(block.bounds(ids, weights)[1] >= reach[i])
                if len(may):
                    found = zip(block.scores(ids, weights, may).tolist(), may.tolist(), strict=True)
                    ranked = [(-s, doc_ids[d] is None, doc_ids[d] or 0) for s, d in found if s > 0]
                    best[i] = heapq.nsmallest(k, best[i] + ranked)
        flat = [(i, None if null else doc, -s) for i, x in enumerate(best) for s, null, doc in x]
        yield batch(pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]), [list(x) for x in zip(*flat, strict=True)] or [[], [], []])

    return run


def _found(found: Index, rows: list, k: int) -> DataFrame:
    """item_id, item, rank, doc_id and score for a block of items."""
    spark, blocks = found.blocks.sparkSession, found.blocks
    asked = [(item_id, Counter(terms_of((text or "").encode()))) for item_id, text in rows]
    vocabulary = sorted(set().union(*(t for _, t in asked)))
    held = np.zeros(len(vocabulary), np.int64)
    for term, n in blocks.select("terms", "ends").mapInArrow(tidy(_held(vocabulary)), "term long, held long").groupBy("term").agg(F.sum("held")).collect():
        held[term] = n
    place = {t: i for i, t in enumerate(vocabulary)}
    of_term = np.array([weight(found.docs, n) for n in held.tolist()], np.int64)
    items = []
    for _, each in asked:
        ids = np.array([place[t] for t in each], np.intp)
        items.append((ids, of_term[ids] * np.array(list(each.values()), np.int64)))
    query = spark.sparkContext.broadcast((vocabulary, items))
    low = blocks.select("terms", "ends", "docs", "impacts").mapInArrow(tidy(_lower(query, k)), "item long, low long")
    kth = low.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("n") == k)
    reach = np.ones(len(items), np.int64)
    for item, least in kth.select("item", "low").collect():
        reach[item] = max(least, 1)
    scored = blocks.mapInArrow(tidy(_exact(query, spark.sparkContext.broadcast(reach), k)), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(asked)], "item long, item_id long")
    return written(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))


def search(found: Index, items: DataFrame, k: int = 10, at_once: int = QUERIES) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score of the k documents of the highest scores
    above 0 for each row of ``items`` (item_id long, text string), of which about ``at_once``
    bytes are broadcast at a time."""
    rows = items.select("item_id", "text")
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // at_once
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not found.docs:
        return out
    with small_batches(spark, 1):
        for part in range(parts):
            own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
            if own:
                out = out.union(_found(found, own, k))
    return out
