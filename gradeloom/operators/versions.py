"""What becomes of a task's arriving questions: inserted, put in another's place, or left out.

Each decision depends on those before it, so a task's rows are sorted by arrival and folded as
they stream by.  The fold keeps no rows: only what it must know of each question so far, its
signature, index and score, and two dictionaries that lead to it.  What a question is in the
end is the last of its rows that was kept, which Spark takes from the decisions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


class _Task:
    """A task's questions, as [signature, index, score], and the ways that lead to them."""

    def __init__(self) -> None:
        self.questions: list[list] = []
        self.begin()

    def begin(self) -> None:
        """A batch looks at the questions as they are when it comes."""
        self.by_signature = {q[0]: (n, q[2]) for n, q in enumerate(self.questions) if q[0] is not None}
        self.by_index = {q[1]: n for n, q in enumerate(self.questions)}

    def settle(self, signature: str | None, index: int, score: float) -> tuple[int, str]:
        if signature is not None and signature in self.by_signature:
            # the score that counts is the one the signature came with, whatever has happened since
            n, least = self.by_signature[signature]
            kept = score > least
            if kept:
                self.by_index[index] = n
        elif index in self.by_index:
            n = self.by_index[index]
            kept = score > self.questions[n][2] + 1
        else:
            n = len(self.questions)
            self.questions.append([signature, index, score])
            self.by_index[index] = n
            if signature is not None:
                self.by_signature[signature] = (n, score)
            return n, "inserted"
        if kept:
            self.questions[n] = [signature, index, score]
        return n, "replaced" if kept else "removed"


def _settled(task: str, batch: str, index: str, signature: str, score: str):
    def run(batches):
        now, part, own = object(), object(), _Task()
        for b in batches:
            questions, actions = [], []
            for t, k, i, s, v in zip(*(b.column(c).to_pylist() for c in (task, batch, index, signature, score)), strict=True):
                if t != now:
                    now, part, own = t, k, _Task()
                elif k != part:
                    part = k
                    own.begin()
                n, action = own.settle(s, i or 0, v or 0)
                questions.append(n)
                actions.append(action)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(questions, pa.int32()), pa.array(actions, pa.string())], names=[*b.schema.names, "question", "action"])

    return run


def settled(rows: DataFrame, task: str, batch: str, order: str, index: str, signature: str, score: str) -> DataFrame:
    """Rows with question, the number (from 0) of the task's question that each is a version of,
    and action: inserted, replaced (it took the question's place) or removed.

    Of a known signature a row counts if it scores more than the signature's first row in the
    batch's view; else, of a known index, if it scores more than the question by more than 1;
    else it is a new question.  A null index or score is 0; a null signature is known by none.
    Equal (batch, order) of a task come in any order.  A task is one paper, in one partition."""
    schema = StructType([*rows.schema, StructField("question", IntegerType()), StructField("action", StringType())])
    return rows.repartition(task).sortWithinPartitions(task, batch, order).mapInArrow(_settled(task, batch, index, signature, score), schema)


def final_versions(decided: DataFrame, task: str, batch: str, order: str) -> DataFrame:
    """Each question's last row that was kept."""
    last = F.row_number().over(Window.partitionBy(task, "question").orderBy(F.desc(batch), F.desc(order)))
    return decided.where(F.col("action") != "removed").withColumn("_n", last).where(F.col("_n") == 1).drop("_n", "action")


def version_counts(decided: DataFrame, task: str) -> DataFrame:
    """Per task: inserted, replaced, removed; detected, the repeats; saved, the rows written."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return decided.groupBy(task).agg(n("inserted").alias("inserted"), n("replaced").alias("replaced"), n("removed").alias("removed"), n("replaced", "removed").alias("detected"), n("inserted", "replaced").alias("saved"))
