"""Callbacks of parse tasks with state that outlives a batch: a task's materials by their
temporary ids, its counters, and messages that came too early.

A sender numbers a task's messages from 0.  They are applied in that order, however they
arrive: one that is ahead of its turn waits in the state, one that comes again is passed
over.  So the final state doesn't depend on how messages were dealt to batches, and a run
that is taken up again from its checkpoint ends like one that was never stopped.

While a task is paused its messages are ignored, as the platform does it, or, if asked for,
held and applied when it goes on.

A call of Python and its state cost milliseconds, whatever is in them.  So tasks are dealt to
buckets by a hash, and a bucket's tasks are one group of the stream with one state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradeloom.sources.shared import shared_dir

#: kind is materials, questions, finish, fail, pause or resume; amount is a number of questions
#: or, for finish, the total; announced is the number of questions that a sender knows of.
MESSAGE = "task long, seq long, kind string, temp_id string, material_id long, amount long, announced long"
RESULT = "task long, applied long, status string, progress int, done long, total long, materials long, linked long, material_sum long, ignored long, repeats long, waiting long"
_FIELDS = ("status", "progress", "done", "total", "linked", "material_sum", "ignored", "repeats", "applied")
_MESSAGE = ("seq", "kind", "temp_id", "material_id", "amount", "announced")
_WAITING = "array<struct<seq: long, kind: string, temp_id: string, material_id: long, amount: long, announced: long>>"
STATE = (
    "tasks array<struct<task: long, status: string, progress: int, done: long, total: long, linked: long, material_sum: long, ignored: long, repeats: long, applied: long, "
    f"temp_ids: array<string>, material_ids: array<long>, early: {_WAITING}, held: {_WAITING}>>"
)
#: Buckets, which a checkpoint is bound to; messages of one, where a table's number is known.
BUCKETS, OF_BUCKET = 256, 8192


class _Task:
    """A task's state, and what a message does to it."""

    def __init__(self, saved: tuple | None, hold: bool):
        self.hold = hold
        if saved is None:
            saved = ("pending", 0, 0, 0, 0, 0, 0, 0, 0, [], [], [], [])
        self.__dict__.update(zip(_FIELDS, saved, strict=False))
        self.materials = dict(zip(saved[9], saved[10], strict=True))
        self.early = {m[0]: tuple(m) for m in saved[11]}
        self.held = [tuple(m) for m in saved[12]]

    def saved(self) -> tuple:
        return (*(getattr(self, f) for f in _FIELDS), list(self.materials), list(self.materials.values()), list(self.early.values()), self.held)

    def arrive(self, message: tuple) -> None:
        if message[0] < self.applied or message[0] in self.early:
            self.repeats += 1
            return
        self.early[message[0]] = message
        while (now := self.early.pop(self.applied, None)) is not None:
            self.applied += 1
            self.apply(now)

    def apply(self, message: tuple) -> None:
        _, kind, temp_id, material_id, amount, announced = message
        if kind == "pause":
            self.status = "paused" if self.status in ("pending", "processing") else self.status
        elif kind == "resume":
            if self.status == "paused":
                self.status = "processing"
                waiting, self.held = self.held, []
                for m in waiting:
                    self.apply(m)
        elif self.status == "paused":
            if self.hold:
                self.held.append(message)
            else:
                self.ignored += 1
        elif kind == "materials":
            self.materials[temp_id] = material_id
        elif kind == "questions":
            self.done += amount
            known = self.materials.get(temp_id)
            self.linked += amount if known is not None else 0
            self.material_sum += known or 0
            self.status = "processing"
            if announced:
                self.total = announced
                self.progress = min(95, max(15, (180 * self.done + announced) // (2 * announced)))
        elif kind == "finish":
            total = amount or self.done
            self.done, self.total, self.progress = self.done or total, total, 100
            self.status = "done" if total else "failed"
            self.materials = {}
        elif kind == "fail":
            self.status, self.progress = "failed", 100


def _values(column: pd.Series, kind: type) -> list:
    return [None if pd.isna(v) else kind(v) for v in column.tolist()]


def _fold(hold: bool):
    kinds = (int, str, str, int, int, int)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tasks = {t[0]: _Task(tuple(t)[1:], hold) for t in state.get[0]} if state.exists else {}
        touched = {}
        for pdf in batches:
            columns = [_values(pdf[c], kind) for c, kind in zip(_MESSAGE, kinds, strict=True)]
            for name, *message in zip(_values(pdf["task"], int), *columns, strict=True):
                task = tasks.get(name)
                if task is None:
                    task = tasks[name] = _Task(None, hold)
                touched[name] = task
                task.arrive(tuple(message))
        state.update(([(name, *task.saved()) for name, task in tasks.items()],))
        out = [{"task": name, "materials": len(t.materials), "waiting": len(t.early) + len(t.held)} | {f: getattr(t, f) for f in _FIELDS} for name, t in touched.items()]
        yield pd.DataFrame(out, columns=names, dtype=object)

    return fold


def task_states(messages: DataFrame, hold: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """A row for each task that a batch of the stream ``messages`` touches: its state after it."""
    dealt = messages.withColumn("bucket", F.pmod(F.xxhash64("task"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(_fold(hold), RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_end(messages: DataFrame, folder: str, hold: bool = False, buckets: int = BUCKETS) -> None:
    """Takes up the stream where its checkpoint in ``folder`` ended, and follows it to its
    present end.  A batch writes a folder of its own, again if it is replayed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/states/{number:08d}")

    query = task_states(messages, hold, buckets).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def last_states(spark, folder: str) -> DataFrame:
    """Each task's latest state.  Every batch has one row a task it touched."""
    rows = spark.read.parquet(f"{folder}/states/*")
    row = F.struct(*[c for c in rows.columns if c != "batch"])
    return rows.groupBy(F.col("task").alias("_task")).agg(F.max_by(row, "batch").alias("_row")).select("_row.*")


def replayed(messages: DataFrame, batches: int = 4, hold: bool = False) -> DataFrame:
    """States of all tasks after a table of messages is streamed from files in so many batches,
    in which a task's messages lie in any order."""
    spark = messages.sparkSession
    folder, files = shared_dir(spark), spark.sparkContext.defaultParallelism
    messages.repartition(batches * files).write.parquet(f"{folder}/messages")
    buckets = max(64, spark.read.parquet(f"{folder}/messages").count() // OF_BUCKET)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/messages")
    run_to_end(stream, folder, hold, buckets)
    return last_states(spark, folder)
