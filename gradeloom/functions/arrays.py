"""Arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(a: Column) -> Column:
    """The finite numbers of an array of texts; null if there are none."""
    own = F.filter(F.transform(a, lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(F.size(own) > 0, own)


def texts(a: Column) -> Column:
    """Trimmed, without blanks; null becomes empty."""
    own = F.filter(F.transform(a, lambda x: F.trim(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(own, F.array().cast("array<string>"))


def distinct_texts(a: Column) -> Column:
    """As texts(), each once, at its first place."""
    return F.array_distinct(texts(a))


def ordered_union(*arrays: Column) -> Column:
    """Distinct values in order of first sight; nulls count as empty."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])))


def distinct_numbers(a: Column, b: Column) -> Column:
    return F.array_union(F.coalesce(a, F.array().cast("array<int>")), F.coalesce(b, F.array().cast("array<int>")))


def json_array(text: Column, kind: str = "array<string>") -> Column:
    """A JSON array, or an empty one."""
    return F.coalesce(F.from_json(text, kind), F.array().cast(kind))


def json_object(text: Column, kind: str = "map<string,string>") -> Column:
    """A JSON object, or an empty one."""
    return F.coalesce(F.from_json(text, kind), F.create_map().cast(kind))


def options_of(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Options A to D that aren't blank."""
    pairs = [F.struct(F.lit(k).alias("key"), F.trim(v).alias("value")) for k, v in zip("ABCD", (a, b, c, d), strict=True)]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.coalesce(p["value"], F.lit("")) != ""))


def upper_keys(m: Column) -> Column:
    """Options by upper-case label, without blanks; of two cases of a label the upper one wins."""
    keep = F.map_filter(m, lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")
    lower = F.filter(F.map_entries(keep), lambda e: (e["key"] != F.upper(e["key"])) & ~F.array_contains(F.map_keys(keep), F.upper(e["key"])))
    upper = F.filter(F.map_entries(keep), lambda e: e["key"] == F.upper(e["key"]))
    return F.map_from_entries(F.concat(upper, F.transform(lower, lambda e: F.struct(F.upper(e["key"]).alias("key"), e["value"].alias("value")))))


def merged(first: Column, second: Column) -> Column:
    """The second map's values over the first's, nulls aside."""
    own = F.map_filter(second, lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(own), k)), own)


def last_wins(entries: Column) -> Column:
    """A map of (key, value) entries in which a key's last entry counts."""
    n = F.size(entries)
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda x: x["key"] == e["key"])
    keep = F.filter(entries, lambda e, i: ~later(e, i))
    return F.map_from_entries(keep)


def first_wins(entries: Column) -> Column:
    earlier = lambda e, i: F.exists(F.slice(entries, 1, i), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~earlier(e, i)))


def renumbered(images: Column) -> Column:
    """(key, position from 1) of an array's values, blanks aside."""
    return F.transform(texts(images), lambda x, i: F.struct(x.alias("ref"), (i + 1).alias("image_order")))


def image_key(url: Column, ref: Column, data: Column) -> Column:
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(blank(url), blank(ref), blank(data))


def sorted_distinct(a: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(a)))
