"""Operators in which each step depends on what the one before it left: rows sorted within a page
or a document, folded as they stream by."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, IntegerType, StringType, StructField, StructType


CORNERS = ("x0", "y0", "x1", "y1")


def _folded(rows: DataFrame, group: list[str], order: list[str], inputs: list[str], begin: Callable[[], Callable], name: str | None = None, kind: DataType | None = None) -> DataFrame:
    """``rows`` group by group, in order, streaming: ``begin`` makes a group's step, which is
    called with each row's inputs.  What it returns becomes a column, or, without a name, tells
    whether the row is kept.  Nothing is held but what the step keeps."""

    def run(batches):
        now, step = None, None
        for b in batches:
            keys = zip(*(b.column(g).to_pylist() for g in group), strict=True)
            out = []
            for key, *values in zip(keys, *(b.column(c).to_pylist() for c in inputs), strict=True):
                if step is None or key != now:
                    now, step = key, begin()
                out.append(step(*values))
            if name is None:
                yield b.filter(pa.array(out, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, to_arrow_type(kind))], names=[*b.schema.names, name])

    schema = rows.schema if name is None else StructType([*rows.schema, StructField(name, kind)])
    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def kept_anchors(rows: DataFrame, group: list[str], at: str, least: int = 3) -> DataFrame:
    """Anchors, without those less than so many characters after the last one kept."""

    def begin():
        last = None

        def step(x) -> bool:
            nonlocal last
            if last is not None and x - last < least:
                return False
            last = x
            return True

        return step

    return _folded(rows, group, [at], [at], begin)


def chapter_paths(rows: DataFrame, group: list[str], order: str, level: str, title: str, most: int = 4) -> DataFrame:
    """Each line's chapter path: a title of level n (from 0) follows the first n titles of the
    path so far; lines without a level keep it."""

    def begin():
        path: list[str] = []

        def step(n, name) -> str:
            nonlocal path
            if n is not None:
                path = [*path[: int(n)], name or ""][-most:]
            return "/".join(path)

        return step

    return _folded(rows, group, [order], [level, title], begin, "path", StringType())


def clustered_boxes(rows: DataFrame, group: list[str], margin: float) -> DataFrame:
    """Each box put into the first cluster with which it, grown by a margin, shares area, from
    the top down; adds column cluster."""

    def begin():
        clusters: list[tuple] = []

        def step(x0, y0, x1, y1) -> int:
            for k, c in enumerate(clusters):
                if x0 - margin < c[2] and x1 + margin > c[0] and y0 - margin < c[3] and y1 + margin > c[1]:
                    clusters[k] = (min(c[0], x0), min(c[1], y0), max(c[2], x1), max(c[3], y1))
                    return k
            clusters.append((x0, y0, x1, y1))
            return len(clusters) - 1

        return step

    return _folded(rows, group, ["y0", "x0", "x1", "y1"], ["x0", "y0", "x1", "y1"], begin, "cluster", IntegerType())


def merged_boxes(rows: DataFrame, group: list[str], gap: float, overlap: float = 0.6) -> DataFrame:
    """Boxes (x0, y0, x1, y1) from the top down, each joined to the one before it if it shares
    60% of its width and is near enough below; the box so far grows as it goes."""
    parts = StructType([*(rows.schema[g] for g in group), *(StructField(c, k) for c, k in (("part", IntegerType()), *((c, DoubleType()) for c in CORNERS), ("n", IntegerType())))])
    names, kinds = parts.names, [to_arrow_type(f.dataType) for f in parts]

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        now, part, a = None, 0, None
        for b in batches:
            done = []
            keys = zip(*(b.column(g).to_pylist() for g in group), strict=True)
            for key, x0, y0, x1, y1 in zip(keys, *(b.column(c).to_pylist() for c in CORNERS), strict=True):
                if a is not None and key == now:
                    shared = min(a[2], x1) - max(a[0], x0)
                    if shared / max(1.0, min(a[2] - a[0], x1 - x0)) > overlap and y0 - a[3] <= gap:
                        a = (min(a[0], x0), min(a[1], y0), max(a[2], x1), max(a[3], y1), a[4] + 1)
                        continue
                if a is not None:
                    done.append((*now, part, *a))
                now, part, a = key, part + 1 if a is not None and key == now else 0, (x0, y0, x1, y1, 1)
            if done:
                yield batch(done)
        if a is not None:
            yield batch([(*now, part, *a)])

    # a box without a corner joins none
    corners = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in CORNERS]
    own = rows.select(*group, *corners).repartition(*group).sortWithinPartitions(*group, "y0", "x0", "x1", "y1")
    return own.mapInArrow(run, parts)
