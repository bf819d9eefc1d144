"""Artifacts appear together or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gradeloom.sources.artifacts import ArtifactSet


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(1, "t/1", "a\nb"), (2, "t/1", None), (3, "t2", "c")], "id long, task string, text string")


def some(condition):
    return (condition, F.struct("id", "text"))


def test_read_back(spark, tmp_path, rows):
    kept = ArtifactSet(spark, str(tmp_path))
    assert kept.manifest() is None and kept.read("all", "id long").count() == 0
    found = kept.publish(rows, {"all": some(F.lit(True)), "late": some(F.col("id") > 1), "none": some(F.col("text") == "x")}, ["task"])
    assert found["counts"] == {"all": 3, "late": 2, "none": 0} == kept.manifest()["counts"]
    for name, n in found["counts"].items():
        assert kept.read(name, "id long, text string, task string").count() == n
    assert sorted(map(tuple, kept.read("all", "id long, text string, task string").collect())) == [(1, "a\nb", "t/1"), (2, None, "t/1"), (3, "c", "t2")]


def test_failed_write_leaves_the_old_set(spark, tmp_path, rows):
    kept = ArtifactSet(spark, str(tmp_path))
    kept.publish(rows, {"all": some(F.col("id") < 3)})
    broken = rows.withColumn("text", F.when(F.col("id") == 3, F.raise_error(F.lit("down"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="down"):
        kept.publish(broken, {"all": some(F.lit(True)), "more": some(F.lit(True))})
    assert kept.manifest()["counts"] == {"all": 2}
    assert sorted(r.id for r in kept.read("all", "id long, text string").collect()) == [1, 2]
    assert kept.read("more", "id long").count() == 0


def test_second_set_replaces_the_first(spark, tmp_path, rows):
    kept = ArtifactSet(spark, str(tmp_path))
    kept.publish(rows, {"a": some(F.lit(True)), "b": some(F.lit(True))})
    kept.publish(rows.limit(0), {"a": some(F.lit(True))})
    assert kept.manifest()["counts"] == {"a": 0} and kept.read("a", "id long").count() == kept.read("b", "id long").count() == 0
