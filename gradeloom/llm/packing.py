"""Harmonic packing of tokenised documents into fixed-length sequences.

The capacity C has the reciprocal classes C//1, C//2, C//3 ...; a bin of the class with
length s holds exactly C//s pieces.  Any cut is allowed, so a document is cut to class
lengths, the longest first, and each class's bins fill up but for less than C//s tokens.
Every worker fills the bins of its own part of the input, in one pass and without a
shuffle.  What its last, open bins hold (under C tokens a class, whatever the part's size)
goes to fewer workers, level by level; the last worker puts its open bins together.

Cases: a null or empty text is one end token.  Null or repeated doc_ids are rows like any
other.  No rows give no rows.  A text of any length is cut whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.bpe import encoder, forget
from gradeloom.llm.shared import batch, small_batches, tidy, written

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open", pa.bool_())])
DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"
#: Pieces in open bins that one task of a later level takes.
PER_TASK = 100_000
#: Bytes of ids in a batch handed back.
BATCH = 4_000_000


def classes(capacity: int) -> list[int]:
    """The lengths of the reciprocal classes, falling."""
    return sorted({capacity // i for i in range(1, capacity + 1)}, reverse=True)


def cuts(n: int, lengths: list[int]) -> list[int]:
    """The lengths of the pieces that n tokens are cut to."""
    out = [lengths[0]] * (n // lengths[0])
    n %= lengths[0]
    for s in lengths[1:]:
        while n >= s:
            out.append(s)
            n -= s
    return out


class Bins:
    """Open bins of each class; full ones come out with their sequence's number."""

    def __init__(self, capacity: int, level: int, task: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}
        self.number = (level << 56) | (task << 32)
        self.rows: list[list] = [[] for _ in SCHEMA]
        self.bytes = 0

    def add(self, piece: tuple) -> None:
        """piece: doc_id, start, length, doc_tokens, ids."""
        own = self.open.setdefault(piece[2], [])
        own.append(piece)
        if len(own) == self.capacity // piece[2]:
            self.close(own)
            del self.open[piece[2]]

    def close(self, pieces: list[tuple], is_open: bool = False) -> None:
        offset = 0
        for doc_id, start, length, total, ids in pieces:
            for column, x in zip(self.rows, (doc_id, start, length, total, None if is_open else self.number, None if is_open else offset, ids, is_open), strict=True):
                column.append(x)
            offset += length
            self.bytes += len(ids)
        self.number += not is_open

    def together(self) -> None:
        """The open bins' pieces, longest first, each into the first sequence with room."""
        room: list[int] = []
        inside: list[list[tuple]] = []
        for pieces in sorted(self.open.values(), key=lambda x: -x[0][2]):
            for piece in pieces:
                k = next((k for k, free in enumerate(room) if free >= piece[2]), len(room))
                if k == len(room):
                    room.append(self.capacity)
                    inside.append([])
                room[k] -= piece[2]
                inside[k].append(piece)
        for pieces in inside:
            self.close(pieces)

    def taken(self) -> pa.RecordBatch:
        out, self.rows, self.bytes = batch(SCHEMA, self.rows), [[] for _ in SCHEMA], 0
        return out


def _first(path: str, keeps_space: bool, end_id: int, capacity: int, memory: float):
    lengths = classes(capacity)

    def run(batches):
        bins = Bins(capacity, 0, TaskContext.get().partitionId())
        own = encoder(path, keeps_space, memory)
        for b in batches:
            doc_ids = iter(b.column("doc_id").to_pylist())
            for ids, ends in own.runs(b.column("text"), end_id):
                data, begin = ids.astype("<u4", copy=False).tobytes(), 0
                for end in ends.tolist():
                    doc_id, start = next(doc_ids), 0
                    for length in cuts(end - begin, lengths):
                        bins.add((doc_id, start, length, end - begin, data[4 * (begin + start) : 4 * (begin + start + length)]))
                        start += length
                    begin = end
                    if bins.bytes > BATCH:
                        yield bins.taken()
        for pieces in bins.open.values():
            bins.close(pieces, is_open=True)
        yield bins.taken()

    return tidy(run, forget if memory < 1 else lambda: None)


def _later(level: int, last: bool, capacity: int):
    def run(batches):
        bins = Bins(capacity, level, TaskContext.get().partitionId())
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids")), strict=True):
                bins.add(row)
            if bins.bytes > BATCH:
                yield bins.taken()
        if last:
            bins.together()
        else:
            for pieces in bins.open.values():
                bins.close(pieces, is_open=True)
        yield bins.taken()

    return run


def pack(docs: DataFrame, tokenizer: str, keeps_space: bool = True, end_id: int = 0, capacity: int = 1024, memory: float = 1.0) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with their place in sequences of ``capacity``.

    Returns doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian
    unsigned 32-bit); a sequence's pieces lie gapless from offset 0.  ``memory`` below 1 makes
    workers remember less of the tokenizer's work, and nothing once a task is done.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        table = written(docs.mapInArrow(_first(tokenizer, keeps_space, end_id, capacity, memory), DDL))
    done = [table.where(~F.col("open"))]
    level, before = 1, None
    while True:
        rest = table.where("open")
        n = rest.count()
        tasks = max(1, n // PER_TASK)
        if before is not None and n >= before:
            tasks = 1
        last, before = tasks == 1, n
        table = rest.coalesce(1) if last else rest.repartition(tasks)
        table = written(table.mapInArrow(_later(level, last, capacity), DDL))
        done.append(table.where(~F.col("open")))
        if last:
            break
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open")
