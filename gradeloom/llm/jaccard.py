"""Size-aware heavy-light join of shingle sets by Jaccard similarity, exact.

Equal sets are one node.  Two nodes are brought together by a common key:

* light (small) nodes have a key for each of their subsets that can be an intersection with
  a partner: all subsets that lack at most (1 - t) n shingles;
* heavy (large) nodes are in the inverted lists of their prefix, the first n - ceil(t n) + 1
  shingles in one global order, in which shingles that are rare come first; a list's members
  are compared only where their places in it still allow enough common shingles.

The boundary is the one with the least estimated cost, enumerations below it and postings
above it, from the table of set sizes and the measured length of the inverted lists.

The order: shingles with a hash in the lowest quarter come first, of these by how often they
are in any node's hash-order prefix (powers of two), then by hash.  It is a function of the
shingle alone, so the prefixes are exact; the counts, over all documents, are kept in a table
of fixed size, in which a collision only moves a shingle back.

A list in which few members could be similar by size and place emits their pairs.  Members of
any other list meet again with a sketch each, which tells most of them apart, and emit stars of
those that could still be similar, no pairs.  A sketch has the parity of a set's shingles in
each of its slots: sets differ by as many shingles at least as their sketches by bits, so what
differs by too many bits isn't similar.  Pairs are told apart by whole sketches, members of lists
by ``DENSE`` bits of them.  Without this, passages that many documents share, and shingles that
are shared by chance, would bring together ever more of the documents as the input grows.

The links' components are groups, and a group's sets meet, each sent once, in one task.  A group of more
than ``TILE`` sets or ``SHINGLES`` shingles is first compared, block by block, with ``HUBS`` sets
of its own, which joins what is alike in one step whose cost is the group's size.  What that
leaves apart meets in blocks: of a class of sets that are joined already, or of single ones,
with sizes that can be similar; blocks of one class don't meet, as nothing in them is left to
join.  Where sets meet every pair that can be similar is compared exactly, by matrix products
over the meeting's own shingles, and links that join what isn't joined yet come out.
Components of links are what documents are labelled with.

Cases: a null or empty text, or one without words, has the empty set and is linked with
nothing, not even its like.  Fewer words than a shingle: the whole sequence is one shingle.
Equal rows share a component.  A null doc_id is a document; a component's name is its least
doc_id that isn't null.  No rows: no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.components import components
from gradeloom.llm.shared import batch, free, mixed, small_batches, tidy, written

#: Sets and shingles of one task's block; a larger group is dealt out in pairs of blocks.
TILE, SHINGLES = 256, 200_000
#: Sets of a large group that all others are compared with first.
HUBS = 8
#: Members of a list whose possible pairs are told apart one by one where it is first read;
#: longer lists' members, and those with more than ``SPARSE`` pairs a member, meet with their sketches.
LIST, SPARSE = 256, 2
#: Members of a list that are compared by sketches; a longer one is one star.
LONG = 2**17
#: Bits of a sketch in lists, and of the longest sketch.
DENSE, SKETCH = 512, 2**16
#: Of the hash range, the part whose shingles are ordered by frequency.
REGION = np.uint64(2**62)
#: Light sets are smaller than this, whatever the cost.
SMALL = 64
#: Bytes of the frequency table, least and most.
SLOTS = (2**20, 2**27)
#: Bytes of the words whose hashes a worker remembers; what is longer isn't kept.
WORDS_KNOWN, WORD_KNOWN = 3_000_000, 64
#: What telling two members of a list apart costs, where shuffling a posting costs 1.
APART = 0.1
MULTIPLIERS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class _Words(dict):
    size = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= WORD_KNOWN:
            if self.size >= WORDS_KNOWN:
                self.clear()
            self.size += len(word)
            self[word] = h
        return h

    def clear(self) -> None:
        super().clear()
        self.size = 0


_WORDS = _Words()


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text; A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII only, in both
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            total += h[i : len(h) - k + 1 + i] * MULTIPLIERS[i]
    return np.unique(mixed(total))


def set_hash(s: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """Bytes of the parities of a set's shingles in slots, of which there are as many as shingles
    or more (``DENSE`` to ``SKETCH``, a power of two); halves can be laid upon each other."""
    bits = DENSE
    while bits < min(len(s), SKETCH):
        bits *= 2
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool))


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """A sketch of so many bytes from one of as many or more."""
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def subset(self, n):
        """The least intersection of a set of n with any partner."""
        return -(-self.num * n // self.den)

    def both(self, a, b):
        """The least intersection of sets of a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def apart(self, a, b):
        """The most shingles that are in one of similar sets of a and b only."""
        return a + b - 2 * self.both(a, b)

    def prefix(self, n):
        return n - self.subset(n) + 1

    def largest(self, n):
        """The size of the largest partner."""
        return n * self.den // self.num

    def subsets(self, n: int) -> int:
        """How many subsets of n enumeration makes."""
        return sum(math.comb(n, d) for d in range(n - self.subset(n) + 1))


def stored(s: np.ndarray, t: Threshold) -> np.ndarray:
    """What keys need of a set: a small one whole; else the region's shingles, and those of the
    prefix at least."""
    return s if len(s) < SMALL else s[: max(int(t.prefix(len(s))), int(np.searchsorted(s, REGION)))]


def prefix(own: np.ndarray, n: int, t: Threshold, levels: np.ndarray) -> np.ndarray:
    """The first shingles of a set of n, in the global order."""
    inside = int(np.searchsorted(own, REGION))
    region = own[:inside]
    order = np.argsort(levels[(region >> np.uint64(8)) & np.uint64(len(levels) - 1)], kind="stable")
    return np.concatenate([region[order], own[inside:]])[: t.prefix(n)]


def subset_keys(own: np.ndarray, t: Threshold) -> np.ndarray:
    """Hashes of the subsets that can be an intersection with a partner."""
    n = len(own)
    h = mixed(own)
    out = []
    with np.errstate(over="ignore"):
        total = h.sum()
        for d in range(n - t.subset(n) + 1):
            for gone in itertools.combinations(range(n), d):
                out.append(total - h[list(gone)].sum() if d else total)
        # another key space than that of shingles, and one for each subset size
        return mixed(np.array(out, np.uint64) ^ np.uint64(0xA0761D6478BD642F))


def boundary(sizes: dict[int, int], t: Threshold, length: float) -> int:
    """Sets up to this size are light.  A posting costs its shuffle and what its list's members
    cost to be told apart, of which there are ``LIST`` at most; a subset costs its shuffle."""
    best, at, light = None, 0, 0.0
    length = 1 + APART * min(length, LIST)
    heavy = sum(c * t.prefix(n) * length for n, c in sizes.items())
    for x in range(0, 33):
        c = sizes.get(x, 0)
        heavy -= c * t.prefix(x) * length
        light += c * t.subsets(x)
        edge = sum(sizes.get(n, 0) * t.subsets(n) for n in range(x + 1, t.largest(x) + 1))
        if best is None or light + edge + heavy < best:
            best, at = light + edge + heavy, x
    return at


def _sets(n: int, t: Threshold):
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("own", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        seen: set[int] = set()  # a set's shingles leave a task once
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                sizes, nodes, own, sketches = [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text, n)
                    node = set_hash(s) if len(s) else None
                    sizes.append(len(s))
                    nodes.append(node)
                    new = node is not None and node not in seen
                    own.append(stored(s, t).tobytes() if new else None)
                    sketches.append(sketch(s).tobytes() if new else None)
                    seen.add(node)
                yield batch(schema, [part.column("uid").to_pylist(), part.column("doc_id").to_pylist(), sizes, nodes, own, sketches])

    return tidy(run, _WORDS.clear)


def _hash_prefixes(t: Threshold):
    def run(batches):
        for b in batches:
            found = [np.frombuffer(x, np.uint64)[: t.prefix(n)] for x, n in zip(b.column("own").to_pylist(), b.column("n").to_pylist(), strict=True)]
            keys = np.concatenate([x[x < REGION] for x in found] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    return run


def byte_table(rows: DataFrame, slots: int) -> np.ndarray:
    """A table of ``slots`` bytes from rows (slot, value): the greatest value of each slot.  Its
    pieces are put together by tasks; the driver gets the table, whatever the number of rows."""
    piece = min(slots, 2**16)

    def fill(batches):
        at, own = -1, None
        for b in batches:
            slot, value = (b.column(c).to_numpy() for c in ("slot", "value"))
            for k in np.unique(slot // piece).tolist():
                if k != at:
                    if own is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["piece", "data"])
                    at, own = k, np.zeros(piece, np.uint8)
                here = slot // piece == k
                own[slot[here] % piece] = value[here]
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["piece", "data"])

    top = rows.groupBy("slot").agg(F.max("value").alias("value"))
    top = top.repartition(F.floor(F.col("slot") / piece)).sortWithinPartitions("slot")
    out = np.zeros(slots, np.uint8)
    for r in top.mapInArrow(fill, "piece long, data binary").collect():
        out[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["data"], np.uint8)
    return out


def frequency_levels(keys: DataFrame) -> tuple[np.ndarray, float]:
    """The table of log2 counts of keys, by (key >> 8) mod its length, and a posting's mean
    list length."""
    counts = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1))
    many, postings, squares = counts.agg(F.count(F.lit(1)), F.sum("c"), F.sum(F.col("c") * F.col("c"))).first()
    slots = SLOTS[0]
    while slots < SLOTS[1] and slots < 8 * (many or 0):
        slots *= 2
    slot = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(slots - 1))
    table = byte_table(counts.select(slot.cast("long").alias("slot"), F.floor(F.log2("c")).cast("int").alias("value")), slots)
    return table, float(squares or 1) / float(postings or 1)


POSTING = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])


def _postings(t: Threshold, levels, light: int):
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            keys, nodes, sizes, places = [], [], [], []
            for own, n, node in zip(b.column("own").to_pylist(), b.column("n").to_pylist(), b.column("node").to_pylist(), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                own = np.frombuffer(own, np.uint64)
                if n <= t.largest(light):
                    k = subset_keys(own, t)
                    keys.append(k)
                    nodes.append(np.full(len(k), node))
                    sizes.append(np.full(len(k), n, np.int32))
                    places.append(np.zeros(len(k), np.int32))
                if n > light:
                    k = prefix(own, n, t, levels.value)
                    keys.append(k)
                    nodes.append(np.full(len(k), node))
                    sizes.append(np.full(len(k), n, np.int32))
                    places.append(np.arange(len(k), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k in keys], nodes, sizes, places)], schema=POSTING)

    return tidy(run)


def _runs(nodes: np.ndarray, n: np.ndarray, t: Threshold) -> np.ndarray:
    """The least node of each member's run of sizes without a gap too wide."""
    label = np.concatenate([[0], np.cumsum(n[1:] > t.largest(n[:-1]))])
    first = np.full(label[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, label, nodes)
    return first[label]


def _star(nodes: np.ndarray, n: np.ndarray, place: np.ndarray, t: Threshold, long: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, kept): members that may be similar, pair by pair if they are few; else, of all members
    that may be similar to another, each beside the least of those it may be similar to, directly
    or through others, and its number in the list.  Members come in ascending size."""
    count, none = len(nodes), np.zeros(0, np.int64)
    if long or count > LIST:
        return nodes, _runs(nodes, n, t), np.arange(count)
    rest = n - place
    able = (n[None] <= t.largest(n[:, None])) & (n[:, None] <= t.largest(n[None])) & (np.minimum(rest[:, None], rest[None]) >= t.both(n[:, None], n[None]))
    one, two = np.nonzero(np.triu(able, 1))
    if len(one) <= SPARSE * count:
        return nodes[one], nodes[two], none
    hub = nodes.copy()
    while True:
        least = np.where(able, hub[None], hub[:, None]).min(axis=1)
        least = np.minimum(least, hub)
        if (least == hub).all():
            break
        hub = least
    np.fill_diagonal(able, False)
    kept = np.flatnonzero(able.any(axis=1))
    return nodes[kept], hub[kept], kept


#: A pair that may be similar (key is null); or a member a of a list, with b the hub of its star.
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])


def _lists(t: Threshold):
    """Rows of ``FOUND`` of each key's list; rows come sorted by key, size and node."""

    def stars(key, node, n, place, long=()):
        if len(key):
            same = np.concatenate([[False], (key[1:] == key[:-1]) & (node[1:] == node[:-1])])
            key, node, n, place = (x[~same] for x in (key, node, n, place))
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        size = np.diff(np.concatenate([start, [len(key)]]))
        pairs, members = [np.zeros((0, 2), np.int64)], []
        for s, c in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            a, b, kept = _star(node[s : s + c], n[s : s + c], place[s : s + c], t, key[s] in long)
            if len(kept):
                members.append((a, b, key[s + kept], n[s + kept], place[s + kept]))
            elif len(a):
                pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        if len(pairs):
            null = lambda kind: pa.nulls(len(pairs), kind)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), null(pa.int64()), null(pa.int32()), null(pa.int32())], schema=FOUND)
        if members:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*members, strict=True)], schema=FOUND)

    def run(batches):
        held, long = None, None  # rows that wait; the key of a list that is a star already
        for b in batches:
            now = [b.column(c).to_numpy() for c in POSTING.names]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            # a list that may go on waits; of a long one its last member is enough
            key = now[0][-1]
            last = int(np.argmax(now[0] == key))
            if len(now[0]) - last > 8 * LIST:
                # the rest of the list that was a star before may be in this batch, too
                yield from stars(*now, long=(long, key))
                held, long = [x[-1:] for x in now], key
            else:
                yield from stars(*(x[:last] for x in now), long=(long,))
                held = [x[last:] for x in now]
        if held is not None:
            yield from stars(*held, long=(long,))

    return tidy(run)


def linked_by_sketch(n: np.ndarray, place: np.ndarray, sketches: np.ndarray, t: Threshold, cells: int = 200_000) -> np.ndarray:
    """A number for each member of a list, the same for those that size, place and sketch allow to
    be similar, directly or through others.  Members come in ascending size; sketches are rows of
    64-bit words."""
    count, rest = len(n), n - place
    forest = _Forest(count)
    label = np.zeros(count, np.int64)

    def meet(rows: np.ndarray, columns: np.ndarray) -> None:
        """All of some members with all of others; what is joined already is left out."""
        step = max(1, cells // max(1, len(rows)))
        for at in range(0, len(columns), step):
            right = columns[at : at + step]
            low, high = np.minimum(n[rows][:, None], n[right][None]), np.maximum(n[rows][:, None], n[right][None])
            able = (label[rows][:, None] != label[right][None]) & (high <= t.largest(low)) & (np.minimum(rest[rows][:, None], rest[right][None]) >= t.both(low, high))
            i, j = np.nonzero(able)
            i, j = rows[i], right[j]
            near = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64) <= t.apart(n[i], n[j])
            for a, b in np.unique(np.stack([label[i[near]], label[j[near]]], axis=1), axis=0).tolist():
                forest.join(a, b)

    def relabel() -> np.ndarray:
        return np.array([forest.top(x) for x in range(count)], np.int64)

    label = np.arange(count)
    if count * count <= cells:
        meet(label, label)
        return relabel()
    some = np.unique(np.linspace(0, count - 1, HUBS).astype(int))
    for k in some.tolist():  # a list of near copies is joined by these
        meet(np.array([k]), np.arange(np.searchsorted(n, t.subset(n[k])), np.searchsorted(n, t.largest(n[k]), "right")))
    label = relabel()
    names, often = np.unique(label, return_counts=True)
    main = label == names[np.argmax(often)]  # these needn't meet one another
    at = 0
    while at < count:
        stop = min(count, at + 64)
        until = int(np.searchsorted(n, t.largest(n[stop - 1]), "right"))
        rows, columns = np.arange(at, stop), np.arange(at, until)
        meet(rows[~main[rows]], columns)
        meet(rows[main[rows]], columns[~main[columns]])
        at = stop
    return relabel()


def _dense(t: Threshold):
    """Links of stars of lists' members, which come sorted by key, size and node."""
    names = ("key", "node", "n", "place")

    def stars(key, node, n, place, sketches, long=None):
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (node[1:] == node[:-1])])
        key, node, n, place, sketches = (x[~same] for x in (key, node, n.astype(np.int64), place.astype(np.int64), sketches))
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out = []
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
            if key[s] == long:
                hub = _runs(node[s:e], n[s:e], t)
            else:
                label = linked_by_sketch(n[s:e], place[s:e], sketches[s:e], t)
                hub = node[s:e][label]
            out.append(np.stack([node[s:e], hub], axis=1)[hub != node[s:e]])
        links = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    def run(batches):
        held, waits, long = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(c).to_numpy() for c in names] + [np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(b.num_rows, -1)])
            waits += b.num_rows
            key = held[-1][0][-1]
            if held[0][0][0] == key and waits <= LONG:
                continue  # all that waits is one list, which may go on
            now = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.argmax(now[0] == key))
            if waits - last > LONG:
                if last:
                    yield stars(*(x[:last] for x in now), long=long)
                long = key
                yield stars(*(x[last:] for x in now), long=long)
                last = waits - 1
            elif last:
                yield stars(*(x[:last] for x in now), long=long)
            held, waits = [[x[last:] for x in now]], waits - last
        if held:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)), long=long)

    return tidy(run)


def _near_pairs(t: Threshold):
    """Pairs that their sketches allow to be similar."""

    def run(batches):
        for b in batches:
            keep = []
            for n, m, x, y in zip(*(b.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                keep.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= t.apart(n, m))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _short(batches):
    """Sketches of ``DENSE`` bits."""
    for b in batches:
        short = [folded(np.frombuffer(x, np.uint8), DENSE // 8).tobytes() for x in b.column("sketch").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(short, pa.binary())], names=["node", "sketch"])


def candidates(postings: DataFrame, own: DataFrame, t: Threshold) -> DataFrame:
    """Links that connect what any similar pairs of nodes connect, from ``postings`` and the nodes'
    sketches in ``own`` (node, n, sketch)."""
    found = written(postings.mapInArrow(_lists(t), "a long, b long, key long, n int, place int"))
    sketches = written(own.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    pairs = found.where(F.col("key").isNull()).select("a", "b").distinct()
    pairs = pairs.join(sketches.select(F.col("node").alias("a"), "n", F.col("sketch").alias("x")), "a")
    pairs = pairs.join(sketches.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
    members = found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("node"), "n", "place")
    members = members.join(sketches.select("node", "sketch").mapInArrow(_short, "node long, sketch binary"), "node")
    members = members.repartition("key").sortWithinPartitions("key", "n", "node")
    near = pairs.select("a", "b", "n", "m", "x", "y").mapInArrow(_near_pairs(t), "a long, b long")
    with small_batches(own.sparkSession, 2000):
        return written(near.unionByName(members.mapInArrow(_dense(t), "a long, b long")))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links_within(sets: list[np.ndarray], t: Threshold, cells: int = 2_000_000) -> list[tuple[int, int]]:
    """Links that connect what any similar pairs of these sets connect."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    n = np.array([len(sets[i]) for i in order], np.int64)
    # counts of ordinary sets are exact in half the memory
    real, whole = (np.float32, np.int32) if n.max(initial=0) < 10_000_000 else (np.float64, np.int64)
    n = n.astype(whole)
    forest, out = _Forest(len(order)), []
    flat = np.concatenate([sets[i] for i in order])
    _, name, often = np.unique(flat, return_inverse=True, return_counts=True)
    ends = np.cumsum(n)
    common = often[name] > 1  # a shingle of one set adds to no intersection
    names = [name[e - c : e][common[e - c : e]] for e, c in zip(ends.tolist(), n.tolist(), strict=True)]
    width = len(often)
    at = 0
    while at < len(order):
        # rows until the matrix would be too large
        rows, columns = at, np.zeros(0, np.int64)
        while rows < len(order) and rows - at < 512:
            wider = np.union1d(columns, names[rows]) if rows > at else np.unique(names[rows])
            if rows > at and len(wider) * (rows - at + 1) > cells:
                break
            columns, rows = wider, rows + 1
        place = np.full(width, -1, np.int64)
        place[columns] = np.arange(len(columns))
        left = np.zeros((rows - at, len(columns)), real)
        for k in range(at, rows):
            left[k - at, place[names[k]]] = 1
        until = int(np.searchsorted(n, t.largest(n[rows - 1]), "right"))
        step = max(1, cells // max(1, len(columns)))
        for c in range(at, until, step):
            stop = min(until, c + step)
            right = np.zeros((stop - c, len(columns)), real)
            for k in range(c, stop):
                own = place[names[k]]
                right[k - c, own[own >= 0]] = 1
            both = (left @ right.T).astype(whole)
            union = n[at:rows, None] + n[None, c:stop] - both
            for a, b in zip(*np.nonzero(t.den * both >= t.num * union), strict=True):
                if a + at != b + c and forest.join(int(a + at), int(b + c)):
                    out.append((order[a + at], order[b + c]))
        at = rows
    return out


def links_to(hubs: list[np.ndarray], sets: list[np.ndarray], t: Threshold) -> list[tuple[int, int]]:
    """(hub, set) of each pair that is similar; sets are sorted."""
    n = np.array([len(x) for x in sets], np.int64)
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)[:-1]])
    out = []
    for k, hub in enumerate(hubs):
        at = np.searchsorted(hub, flat)
        both = np.add.reduceat((hub[np.minimum(at, len(hub) - 1)] == flat).astype(np.int64), starts)
        out += [(k, int(x)) for x in np.flatnonzero(t.den * both >= t.num * (n + len(hub) - both))]
    return out


def _meetings(t: Threshold, by_hub: bool = False):
    """Links of each meeting; rows (meeting, node, hub, shingles) come sorted by meeting."""

    def links(rows: dict[int, tuple]) -> pa.RecordBatch:
        nodes, sets = list(rows), [x for _, x in rows.values()]
        if by_hub:
            hubs = [k for k, n in enumerate(nodes) if rows[n][0]]
            found = [(hubs[h], x) for h, x in links_to([sets[k] for k in hubs], sets, t) if hubs[h] != x]
        else:
            found = links_within(sets, t)
        return pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        at, rows = None, {}
        for b in batches:
            for key, node, hub, data in zip(*(b.column(c).to_pylist() for c in ("meeting", "node", "hub", "shingles")), strict=True):
                if key != at:
                    if len(rows) > 1:
                        yield links(rows)
                    at, rows = key, {}
                rows[node] = (hub or rows.get(node, (False,))[0], np.frombuffer(data, np.uint64))
        if len(rows) > 1:
            yield links(rows)

    return tidy(run)


def _met(rows: DataFrame, t: Threshold, by_hub: bool = False) -> DataFrame:
    """Links of meetings, from rows (meeting, node, hub, shingles)."""
    rows = rows.select(F.col("meeting").cast("string").alias("meeting"), "node", "hub", "shingles")
    rows = rows.repartition("meeting").sortWithinPartitions("meeting")
    with small_batches(rows.sparkSession, 250):
        return written(rows.mapInArrow(_meetings(t, by_hub), "a long, b long"))


def large_links(sets: DataFrame, t: Threshold) -> DataFrame:
    """Links of groups that are too large for one task, from ``sets`` (group, node, n, shingles),
    which are read several times."""
    some = lambda: F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / SHINGLES)).cast("int")
    part = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")

    # all against a few hubs of the group
    blocks = sets.groupBy("group").agg(some().alias("blocks"))
    first = Window.partitionBy("group").orderBy(F.xxhash64("node", F.lit(HUBS)), "node")
    hubs = sets.select("group", "node").withColumn("place", F.row_number().over(first)).where(F.col("place") <= HUBS).drop("place")
    all_ = sets.join(blocks, "group").select(F.struct("group", part(F.col("blocks")).alias("block")).alias("meeting"), "node", F.lit(False).alias("hub"), "shingles")
    every = sets.join(hubs, ["group", "node"]).join(blocks, "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = every.select(F.struct("group", "block").alias("meeting"), "node", F.lit(True).alias("hub"), "shingles")
    near = _met(all_.unionByName(every), t, by_hub=True)
    label = components(near).withColumnRenamed("component", "label")

    # what is still apart: classes of joined sets, and of single ones, by sizes of which only
    # neighbours can be similar
    size = F.floor(F.log("n") / math.log(t.den / t.num) + 1e-9).cast("int")
    classed = sets.select("group", "node", "n").join(label, "node", "left").withColumn("size", size)
    kinds = classed.groupBy("group", "label", "size").agg(some().alias("blocks"))
    kinds = written(kinds.withColumn("kind", F.struct("group", "label", "size")))
    one = kinds.select("group", F.col("size").alias("near"), F.col("kind").alias("a"), F.col("blocks").alias("na"))
    two = kinds.select("group", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("near"), F.col("kind").alias("b"), F.col("blocks").alias("nb"))
    pairs = one.join(two, ["group", "near"]).where((F.col("a.size") < F.col("b.size")) | (F.coalesce(F.col("a.label"), F.lit(0)) <= F.coalesce(F.col("b.label"), F.lit(0))))
    pairs = pairs.where(F.col("a.label").isNull() | F.col("b.label").isNull() | (F.col("a.label") != F.col("b.label")))
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = pairs.where((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j")))
    meeting = F.struct("a", "i", "b", "j").alias("meeting")
    asked = pairs.select(meeting, F.explode(F.array(F.struct(F.col("a").alias("kind"), F.col("i").alias("block")), F.struct(F.col("b").alias("kind"), F.col("j").alias("block")))).alias("x"))
    key = lambda kind, block: F.to_json(F.struct(kind.alias("k"), block.alias("b")))
    asked = asked.select("meeting", key(F.col("x.kind"), F.col("x.block")).alias("key")).distinct()
    own = classed.join(kinds.select("group", F.col("label").alias("_l"), "size", "blocks"), (F.col("label").eqNullSafe(F.col("_l"))) & (classed["group"] == kinds["group"]) & (classed["size"] == kinds["size"])).select(
        key(F.struct(classed["group"], F.col("label"), classed["size"]), part(F.col("blocks"))).alias("key"), "node"
    )
    # numbers first: sets of a class that meets no other stay where they are
    own = written(own.join(asked, "key").select("meeting", "node"))
    table = sets.sparkSession.sparkContext.broadcast(marked(own.select("node").distinct()))  # of fixed size
    needed = sets.select("node", "shingles").mapInArrow(_marked(table), "node long, shingles binary")
    apart = _met(own.hint("shuffle_merge").join(needed, "node").select("meeting", "node", F.lit(False).alias("hub"), "shingles"), t)
    return near.unionByName(apart)


def slot_of(uid: np.ndarray, slots: int) -> np.ndarray:
    return (uid.view(np.uint64) >> np.uint64(8)) & np.uint64(slots - 1)


def marked(ids: DataFrame) -> np.ndarray:
    """A table of the slots of these numbers (the only column)."""
    (name,) = ids.columns
    slots, n = SLOTS[0], ids.count()
    while slots < SLOTS[1] and slots < 8 * n:
        slots *= 2
    slot = F.shiftrightunsigned(name, 8).bitwiseAND(F.lit(slots - 1)).cast("long")
    return byte_table(ids.select(slot.alias("slot"), F.lit(1).alias("value")), slots)


def _marked(table):
    """Rows whose node the table has."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(table.value[slot_of(b.column("node").to_numpy(), len(table.value))] > 0))

    return run


def _chosen(n: int, table):
    """The whole sets of documents that the table has; others are not even split."""
    schema = pa.schema([("uid", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            uid = b.column("uid").to_numpy()
            hit = np.flatnonzero(table.value[slot_of(uid, len(table.value))])
            for at in range(0, len(hit), 1024):
                rows = [i for i in hit[at : at + 1024].tolist() if int(uid[i]) not in seen]
                texts = b.column("text").take(pa.array(rows, pa.int64())).to_pylist()
                seen.update(int(uid[i]) for i in rows)
                yield batch(schema, [[int(uid[i]) for i in rows], [shingle_set(x, n).tobytes() for x in texts]])

    return tidy(run, _WORDS.clear)


def similar(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, n_shingles, uid, node, component and component_id of each of
    ``docs`` (doc_id, text); and links between nodes that, with their transitive closure, are all links there are."""
    spark: SparkSession = docs.sparkSession
    t = Threshold(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("uid", F.xxhash64("doc_id", "text"))
    with small_batches(spark, 2000):
        rows = written(docs.select("uid", "doc_id", "text").mapInArrow(_sets(words, t), "uid long, doc_id long, n int, node long, own binary, sketch binary"))
    own = rows.where(F.col("own").isNotNull())
    table, length = frequency_levels(own.select("n", "own").mapInArrow(_hash_prefixes(t), "key long"))
    free(spark)
    sizes = {r["n"]: r["count"] for r in own.where(F.col("n") < SMALL).groupBy("n").count().collect()}
    light = boundary(sizes, t, length)
    levels = spark.sparkContext.broadcast(table)  # of fixed size
    postings = own.select("own", "n", "node").mapInArrow(_postings(t, levels, light), "key long, node long, n int, place int")
    postings = postings.repartition("key").sortWithinPartitions("key", "n", "node")
    groups = components(candidates(postings, own, t))
    free(spark)

    # one document of each node in a group brings its set
    bring = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("uid").alias("uid"), F.first("n").alias("n"))
    bring = written(bring.join(groups, "node").select("uid", "node", "n", F.col("component").alias("group")))
    sized = bring.groupBy("group").agg(((F.count(F.lit(1)) > TILE) | (F.sum("n") > SHINGLES)).alias("large"))
    bring = written(bring.join(sized, "group"))

    def brought(some: DataFrame) -> DataFrame:
        """``some`` with its sets' shingles."""
        table = spark.sparkContext.broadcast(marked(some.select("uid")))  # of fixed size
        sets = docs.select("uid", "text").mapInArrow(_chosen(words, table), "uid long, shingles binary")
        return some.hint("shuffle_merge").join(sets, "uid")  # what is brought grows with the input

    meeting = F.col("group").alias("meeting"), "node", F.lit(False).alias("hub"), "shingles"
    links = _met(brought(bring.where(~F.col("large"))).select(*meeting), t)
    if bring.where("large").take(1):
        with small_batches(spark, 2000):
            # rows repeated whole bring a set each from every task; one is enough
            large = written(brought(bring.where("large")).dropDuplicates(["node"]).select("group", "node", "n", "shingles"))
        links = written(links.unionByName(large_links(large, t)))
    named = components(links)
    free(spark)
    firsts = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"))
    firsts = firsts.join(named, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    firsts = firsts.join(least, "component").select(F.col("node").alias("_node"), "component", "component_id")
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node", "uid").join(firsts, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", "node", "uid", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), links


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and others) without near duplicates: of each
    component the row with the least doc_id stays (then the least hash of its text), once.
    Rows without words are linked with nothing and stay."""
    found, _ = similar(docs, words, num, den)
    # a row's place among its component's; a null doc_id comes after all others
    rank = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("uid"))
    linked = found.where(F.col("node").isNotNull())
    # by node first: a component's copies are brought together where they lie
    kept = linked.groupBy("component").agg(F.min(rank).alias("kept"))
    kept = kept.select(F.col("kept.uid").alias("uid"), F.lit(True).alias("once"))
    empty = found.where(F.col("node").isNull()).select("uid", F.lit(False).alias("once")).distinct()
    columns = docs.columns
    stay = docs.withColumn("_uid", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    both = kept.unionByName(empty).withColumnRenamed("uid", "_uid")
    stay = stay.join(both, "_uid")
    once = Window.partitionBy("_uid").orderBy(F.lit(0))
    # rows repeated whole: all but one go
    stay = stay.withColumn("_number", F.row_number().over(once))
    return stay.where(~F.col("once") | (F.col("_number") == 1)).select(*columns)
