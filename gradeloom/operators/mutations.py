"""Changes as batch transforms: a frame in, the changed frame out; and task states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def updated(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Rows that meet a condition get new values."""
    own = F.coalesce(condition, F.lit(False))
    return df.withColumns({k: F.when(own, v).otherwise(F.col(k)) for k, v in values.items()})


def deleted(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def soft_deleted(df: DataFrame, condition: Column, as_of: Column) -> DataFrame:
    return updated(df, condition & F.col("deleted_at").isNull(), deleted_at=as_of)


def batch_outcome(df: DataFrame, ids: DataFrame, key: str, allowed: Column) -> DataFrame:
    """One row: how many of the ids a batch changes, and how many it passes over."""
    both = ids.select(key).distinct().join(df.select(key, allowed.alias("_ok")), key, "left")
    return both.agg(F.count_if(F.coalesce("_ok", F.lit(False))).alias("changed"), F.count_if(~F.coalesce("_ok", F.lit(False))).alias("skipped"))


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key, new ones over old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*[c for c in both.columns if c != "_new"])
    last = both.groupBy(*key).agg(F.max_by(row, F.struct("_new", order)).alias("_row"))
    return last.select("_row.*")


def replaced_set(df: DataFrame, owner: str, owners: DataFrame, wanted: DataFrame) -> DataFrame:
    """All rows of the given owners replaced by those wanted."""
    return df.join(owners.select(owner).distinct(), owner, "left_anti").unionByName(wanted.distinct())


def split_in_two(df: DataFrame, condition: Column, index: str, first: dict[str, Column], second: dict[str, Column], at: int) -> DataFrame:
    """A row becomes two, later indexes making room."""
    hit = F.coalesce(condition, F.lit(False))
    rows = df.withColumn("_half", F.explode(F.when(hit, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    place = F.when(hit, F.col(index) + F.col("_half")).when(F.col(index) > at, F.col(index) + 1).otherwise(F.col(index))
    values = {k: F.when(hit & (F.col("_half") == 0), first[k]).when(hit, second[k]).otherwise(F.col(k)) for k in first}
    return rows.withColumns(values | {index: place}).drop("_half")


def merged_into(df: DataFrame, key: str, target, other, texts: list[str], lists: list[str]) -> DataFrame:
    """Two rows become one: texts joined by a line end, lists one after the other."""
    pair = df.where(F.col(key).isin(target, other)).withColumn("_n", F.when(F.col(key) == target, 0).otherwise(1))
    ordered = F.array_sort(F.collect_list(F.struct("_n", *texts, *lists)))

    def values(c: str) -> Column:
        return F.transform(ordered, lambda r: r[c])

    one = pair.agg(F.count(F.lit(1)).alias("_rows"), *[F.array_join(values(c), "\n").alias(c) for c in texts], *[F.flatten(values(c)).alias(c) for c in lists])
    out = df.where(F.col(key) != other)
    new = one.select(F.lit(target).alias("_k"), *[F.col(c).alias(f"_{c}") for c in (*texts, *lists)])
    joined = out.join(new, F.col(key) == F.col("_k"), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in (*texts, *lists)}).drop("_k", *[f"_{c}" for c in (*texts, *lists)])


#: From which states a task may go where.
MOVES = {
    "start": (("pending",), "processing"),
    "finish": (("processing",), "done"),
    "fail": (("pending", "processing"), "failed"),
    "retry": (("failed", "paused"), "pending"),
    "pause": (("pending", "processing"), "paused"),
}


def moved(status: Column, event: Column) -> Column:
    """The state after an event; null if the event isn't allowed then."""
    out = F.lit(None).cast("string")
    for name, (before, after) in MOVES.items():
        out = F.when((event == name) & status.isin(*before), F.lit(after)).otherwise(out)
    return out


def final_states(events: DataFrame, key: str, order: str) -> DataFrame:
    """Each task's state after its events in order, those not allowed passed over; and how
    many those were.  The events of a task are folded in one expression."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("event").alias("e"))))
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("refused"))

    def step(state: Column, x: Column) -> Column:
        to = moved(state["status"], x["e"])
        return F.struct(F.coalesce(to, state["status"]).alias("status"), (state["refused"] + F.when(to.isNull(), 1).otherwise(0)).alias("refused"))

    out = events.groupBy(key).agg(F.aggregate(own, start, step).alias("_s"))
    return out.select(key, F.col("_s.status").alias("status"), F.col("_s.refused").alias("refused"))


def with_refreshed(questions: DataFrame, stats: DataFrame, key: str, columns: list[str], fresh: Callable[[str], Column] | None = None) -> DataFrame:
    """Materialised figures computed anew."""
    own = stats.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = questions.join(own, questions[key] == own["_k"], "left")
    return out.withColumns({c: F.coalesce(f"_{c}", fresh(c) if fresh else F.lit(0)) for c in columns}).drop("_k", *[f"_{c}" for c in columns])
