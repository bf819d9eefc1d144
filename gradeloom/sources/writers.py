"""Sinks: JSON bundles, CSV manifests, nested exports, callback batches, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_bundle(payloads: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines for each payload."""
    for name, df in payloads.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def manifest(df: DataFrame) -> DataFrame:
    """Nested values as JSON text and null as blank, ready for CSV."""
    out = []
    for f in df.schema:
        nested = f.dataType.typeName() in ("array", "map", "struct")
        c = F.to_json(f.name) if nested else F.col(f.name).cast("string")
        out.append(F.coalesce(c, F.lit("")).alias(f.name))
    return df.select(*out)


def csv_manifest(df: DataFrame, path: str) -> None:
    manifest(df).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def nested_export(banks: DataFrame, materials: DataFrame, questions: DataFrame, key: str = "bank_id") -> DataFrame:
    """A row a bank: its materials and questions as arrays of structs, in order.  A bank's
    export is one value by its nature; arrays are built with partial aggregation."""

    def gathered(df: DataFrame, name: str) -> DataFrame:
        own = F.struct(*[c for c in df.columns if c != key])
        return df.groupBy(key).agg(F.array_sort(F.collect_list(own)).alias(name))

    out = banks.join(gathered(materials, "materials"), key, "left").join(gathered(questions, "questions"), key, "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select(*banks.columns, empty("materials"), empty("questions"))


def batches(df: DataFrame, by: str, order: list[str], size: int = 20) -> DataFrame:
    """``df`` with batch_no, from 0, of ``size`` rows each within a task."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("batch_no", F.floor((n - 1) / size).cast("int"))


def preview(df: DataFrame, order: list[Column], images: str, most: int, with_images: int) -> DataFrame:
    """The first rows, images left out of those beyond the first few."""
    top = df.orderBy(*order).limit(most)
    n = F.row_number().over(Window.orderBy(*order))  # over at most ``most`` rows
    return top.withColumn("_n", n).withColumn(images, F.when(F.col("_n") <= with_images, F.col(images))).drop("_n")


def markdown_table(df: DataFrame) -> str:
    """A report's frame as a Markdown table, whole; rows come to the driver one by one."""
    rows = df.toLocalIterator()
    head = [" | ".join(df.columns), " | ".join("---" for _ in df.columns)]
    return "\n".join(f"| {x} |" for x in [*head, *(" | ".join("" if v is None else str(v) for v in r) for r in rows)])


def replace_partition(df: DataFrame, path: str, key: str) -> None:
    """Rows of the keys present replace those written before: writing twice changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
