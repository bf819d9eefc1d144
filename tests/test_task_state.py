"""State across batches: any dealing of messages, and a restart, end the same."""

from __future__ import annotations

import random

import pytest

from gradeloom.streaming import task_state as S

NEWS = [
    ("materials", "a", 11, 0, 0),
    ("questions", "a", None, 3, 20),
    ("questions", "b", None, 2, 20),
    ("pause", None, None, 0, 0),
    ("materials", "b", 12, 0, 0),
    ("questions", "b", None, 4, 20),
    ("resume", None, None, 0, 0),
    ("questions", "b", None, 1, 0),
    ("finish", None, None, 0, 0),
]
MESSAGES = [(1, n, *m) for n, m in enumerate(NEWS)] + [(2, 0, "finish", None, None, 0, 0)] + [(3, 1, "questions", "a", None, 5, 9)]


def states(rows):
    return {r.task: r.asDict() for r in rows.collect()}


def stream(spark, folder, files):
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, S.MESSAGE).coalesce(1).write.parquet(f"{folder}/messages/{n}")
    return spark.readStream.schema(S.MESSAGE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/messages")


@pytest.mark.parametrize("hold", [False, True])
def test_order_of_arrival(spark, tmp_path, hold):
    found = []
    for seed in (0, 1):
        rows = MESSAGES + MESSAGES[:4]
        random.Random(seed).shuffle(rows)
        folder = str(tmp_path / f"{seed}")
        S.run_to_end(stream(spark, folder, [rows[k::3] for k in range(3)]), folder, hold)
        found.append(states(S.last_states(spark, folder)))
    assert found[0] == found[1]
    one = found[0][1]
    if hold:  # b was known and its four questions came when the task went on
        assert (one["done"], one["linked"], one["material_sum"], one["ignored"]) == (10, 8, 11 + 12 + 12, 0)
    else:
        assert (one["done"], one["linked"], one["material_sum"], one["ignored"]) == (6, 3, 11, 2)
    assert (one["status"], one["progress"], one["materials"], one["repeats"], one["waiting"]) == ("done", 100, 0, 4, 0)
    assert (found[0][2]["status"], found[0][2]["total"]) == ("failed", 0)  # no question at all
    assert (found[0][3]["status"], found[0][3]["waiting"]) == ("pending", 1)  # message 0 has not come


def test_restart_from_checkpoint(spark, tmp_path):
    """Stopped after some files and taken up again: as if never stopped; a third run does nothing."""
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    files = [MESSAGES[k::4] for k in range(4)]
    S.run_to_end(stream(spark, whole, files), whole)
    S.run_to_end(stream(spark, parts, files[:2]), parts)
    assert states(S.last_states(spark, parts)) != states(S.last_states(spark, whole))
    for n, rows in enumerate(files[2:], 2):
        spark.createDataFrame(rows, S.MESSAGE).coalesce(1).write.parquet(f"{parts}/messages/{n}")
    again = lambda: spark.readStream.schema(S.MESSAGE).option("recursiveFileLookup", True).parquet(f"{parts}/messages")
    S.run_to_end(again(), parts)
    assert states(S.last_states(spark, parts)) == states(S.last_states(spark, whole))
    before = sorted(str(p) for p in (tmp_path / "parts" / "states").iterdir())
    S.run_to_end(again(), parts)
    assert sorted(str(p) for p in (tmp_path / "parts" / "states").iterdir()) == before


def test_tasks_of_a_bucket(spark, tmp_path):
    """One group's state keeps all tasks of a bucket apart, and a batch returns those it touches."""
    rows = [(t, *m[1:]) for t in range(20) for m in MESSAGES[: len(NEWS)]] + [(None, 0, *NEWS[0])]
    found = []
    for buckets in (1, 7):
        folder = str(tmp_path / f"{buckets}")
        S.run_to_end(stream(spark, folder, [rows[:50], rows[50:]]), folder, buckets=buckets)
        assert spark.read.parquet(f"{folder}/states/*").count() == 21 + 1  # a task lies in both files
        found.append(states(S.last_states(spark, folder)))
    assert found[0] == found[1] and len(found[0]) == 21
    assert found[0][None]["materials"] == 1 and {found[0][t]["done"] for t in range(20)} == {6}
