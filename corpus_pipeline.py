"""The corpus pipeline: language identification, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.jaccard import keep_one
from gradeloom.llm.language import UNKNOWN, held_out, identify
from gradeloom.llm.mixing import mixed_texts
from gradeloom.llm.packing import pack
from gradeloom.llm.queries import tokenizer
from gradeloom.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; lang becomes the predicted one.  If nothing could be learned
    it stays, or is ``und`` if it is missing."""
    docs = docs.select(*COLUMNS)
    labelled = docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
    known = F.col("lang_pred") != UNKNOWN
    found = identify(docs, labelled).where(known | F.rlike("text", F.lit(r"\p{L}")))
    return found.withColumn("lang", F.when(known, F.col("lang_pred")).otherwise(F.coalesce("lang", F.lit(UNKNOWN)))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80% of their five-word shingles, directly or by way of others,
    the one with the least doc_id stays."""
    return keep_one(docs.select(*COLUMNS), words=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that words of a document are taken."""
    return mixed_texts(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in sequences of 1024."""
    # executors' heaps have grown in the stages before: less is left for Python
    return pack(docs.select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), memory=0.15)


STAGES = [("language id", language), ("near duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Automata, seeded block choice and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
