"""Boxes: arrays of four numbers x0, y0, x1, y1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.array(*[F.lit(v).cast("double") if not isinstance(v, Column) else v.cast("double") for v in (x0, y0, x1, y1)])


def valid(b: Column) -> Column:
    return F.coalesce((F.size(b) == 4) & (b[2] > b[0]) & (b[3] > b[1]), F.lit(False))


def _four(a: Column, b: Column) -> Column:
    return (F.size(a) == 4) & (F.size(b) == 4)


def _shared(a: Column, b: Column, low: int) -> Column:
    """Length that a and b share on one axis; below 0 where they are apart."""
    return F.least(a[low + 2], b[low + 2]) - F.greatest(a[low], b[low])


def _least_one(x: Column) -> Column:
    return F.greatest(x, F.lit(1.0))


def area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(a: Column, b: Column) -> Column:
    """Area that boxes share."""
    w, h = _shared(a, b, 0), _shared(a, b, 1)
    return F.when(_four(a, b) & (w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area, areas counting as 1 at least."""
    w, h = _shared(a, b, 0), _shared(a, b, 1)
    inside = w * h / F.least(_least_one(area(a)), _least_one(area(b)))
    return F.when(_four(a, b) & (w > 0) & (h > 0), inside).otherwise(F.lit(0.0))


def axis_overlap(a: Column, b: Column, low: int) -> Column:
    """Shared length over the smaller one on the x (0) or y (1) axis."""
    w = _shared(a, b, low)
    return F.when(_four(a, b) & (w > 0), w / F.least(_least_one(a[low + 2] - a[low]), _least_one(b[low + 2] - b[low]))).otherwise(F.lit(0.0))


def x_overlap(a: Column, b: Column) -> Column:
    return axis_overlap(a, b, 0)


def y_overlap(a: Column, b: Column) -> Column:
    return axis_overlap(a, b, 1)


def y_gap(a: Column, b: Column) -> Column:
    """Distance on the y axis, 0 where they overlap; infinite if either is no box."""
    return F.when(_four(a, b), F.greatest(b[1] - a[3], a[1] - b[3], F.lit(0.0))).otherwise(F.lit(float("inf")))


def near_in_x(a: Column, b: Column, margin: float = 36.0, band: float = 0.55) -> Column:
    """At most a margin apart in x, or one of them takes most of the band that both are in."""
    width = lambda c: _least_one(c[2] - c[0])
    both = _least_one(F.greatest(a[2], b[2]) - F.least(a[0], b[0]))
    return (_shared(a, b, 0) >= -margin) | (width(a) / both >= band) | (width(b) / both >= band)


def intersects(a: Column, b: Column, closed: bool = False) -> Column:
    """Whether boxes share area, or, closed, at least a point."""
    w, h = _shared(a, b, 0), _shared(a, b, 1)
    return F.coalesce(_four(a, b) & ((w >= 0) & (h >= 0) if closed else (w > 0) & (h > 0)), F.lit(False))


def contains_y(outer: Column, inner: Column) -> Column:
    """Whether the inner box begins within the outer one's height."""
    return (inner[1] >= outer[1]) & (inner[1] <= outer[3])


def grow(b: Column, margin: float, width: Column, height: Column) -> Column:
    """A margin more on all sides, kept on the page."""
    return F.array(F.greatest(b[0] - margin, F.lit(0.0)), F.greatest(b[1] - margin, F.lit(0.0)), F.least(b[2] + margin, width), F.least(b[3] + margin, height))


def scale(b: Column, sx: Column, sy: Column) -> Column:
    return F.array(b[0] * sx, b[1] * sy, b[2] * sx, b[3] * sy)


def most_gap(height: Column) -> Column:
    """How far below a material its questions may begin: 35% of the page, from 120 to 360."""
    return F.least(F.greatest(height * 0.35, F.lit(120.0)), F.lit(360.0))


def first_box(*columns: Column) -> Column:
    """The first that has four numbers, none null."""
    own = [F.when((F.size(c) == 4) & ~F.exists(c, lambda v: v.isNull()), c) for c in columns]
    return F.coalesce(*own)


def union_of(boxes: Column) -> Column:
    """The box around an array of boxes."""
    side = lambda i, f: f(F.transform(boxes, lambda b: b[i]))
    return F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))


def union_agg(b: Column) -> Column:
    """The box around a group's boxes."""
    return F.array(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3]))


def faults(b: Column, width: Column, height: Column) -> Column:
    """What is wrong with a box, as an array of names."""
    found = [
        F.when(~valid(b), F.lit("invalid_box")),
        F.when((b[0] < 0) | (b[1] < 0), F.lit("before_page")),
        F.when((b[2] > width) | (b[3] > height), F.lit("beyond_page")),
    ]
    return F.array_compact(F.array(*found))


def source_page(pages: list[Column], page_range: Column) -> Column:
    """The first of these pages that is neither null nor 0, else the range's first, else 1."""
    return F.coalesce(*[F.nullif(p, F.lit(0)) for p in (*pages, F.get(page_range, F.lit(0)))], F.lit(1))


def source_highlight(box_: Column, page: Column) -> Column:
    """Where a viewer shows a question's source; null if the box has not four numbers."""
    size = lambda k: F.greatest(F.lit(1.0), box_[k + 2] - box_[k])
    own = F.struct(F.greatest(F.lit(1), page).alias("page"), box_[0].alias("x"), box_[1].alias("y"), size(0).alias("width"), size(1).alias("height"))
    return F.when(F.size(box_) == 4, own)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
