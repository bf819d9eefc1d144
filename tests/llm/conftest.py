from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, words: int = 300) -> str:
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", "", ",", ".", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Odd rows: null and empty texts, ties, repeats, long texts, null keys."""
    rng = random.Random(1)
    base = prose(rng, 400)
    out = [
        (0, base, "a", "s1", 1),
        (1, base, "a", "s1", 1),
        (2, base + " one more", "a", "s2", 1),
        (3, None, None, None, None),
        (4, "", "b", "s2", 0),
        (5, "  \n\t ", "b", "s3", 1),
        (6, "É日本 𝒳 ünï ﬁ", "b", "s3", 1),
        (None, "no id here", "a", None, 3),
        (8, "repeated row here", "a", "s1", 1),
        (8, "repeated row here", "a", "s1", 1),
        (9, "two words", "a", "s1", 1),
        (10, "TWO words", "a", "s1", 1),
        (11, "word", None, "s1", 1),
        (12, prose(rng, 30_000, 5000), "a", "s9", 1),
    ]
    return out + [(20 + k, prose(rng, rng.randrange(1, 200)), "ab"[k % 2], f"s{k % 4}", 5) for k in range(60)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def folder(spark, rows, tmp_path_factory):
    """Tables as a query reads them, with an extra column of a clashing name."""
    from pyspark.sql import functions as F

    path = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit(-1), "taken": F.lit("x"), "component_id": F.lit(None).cast("string"), "uid": F.lit(3), "node": F.lit(4)})
    df.repartition(2).write.parquet(str(path / "documents.parquet"))
    return str(path)
