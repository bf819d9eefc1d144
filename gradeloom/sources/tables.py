"""Schemas of the practice platform, and views of the driver's tables in their shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(**kinds: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in kinds.items()))


_OPTION_COLUMNS = {f"option_{x}": "string" for x in "abcd"}


def schemas() -> dict[str, T.StructType]:
    """One declared schema a table."""
    return {
        "users": _schema(id="string", phone="string", nickname="string", role="string", is_active="boolean", last_login_at="timestamp", created_at="timestamp", deleted_at="timestamp"),
        "question_banks": _schema(id="string", name="string", subject="string", source="string", year="int", status="string", total_count="int", created_at="timestamp", deleted_at="timestamp"),
        "questions": _schema(id="string", bank_id="string", material_id="string", parse_task_id="string", index_num="int", type="string", content="string", **_OPTION_COLUMNS, answer="string", analysis="string", images="array<string>", page_num="int", page_range="array<int>", source_bbox="array<double>", parse_confidence="double", parse_warnings="array<string>", ai_audit_status="string", ai_can_solve_question="boolean", ai_reviewed_before_human="boolean", ai_review_error="string", visual_parse_status="string", needs_review="boolean", status="string", answer_count="int", correct_rate="double", created_at="timestamp", deleted_at="timestamp"),
        "materials": _schema(id="string", bank_id="string", parse_task_id="string", content="string", images="array<string>", page_range="array<int>", deleted_at="timestamp"),
        "user_records": _schema(id="string", user_id="string", question_id="string", bank_id="string", user_answer="string", is_correct="boolean", time_spent="int", removed_from_wrong="boolean", is_mastered="boolean", wrong_count="int", created_at="timestamp"),
        "user_question_books": _schema(id="string", user_id="string", bank_id="string"),
        "parse_tasks": _schema(id="string", task_type="string", status="string", progress="int", total_count="int", done_count="int", attempt="int", error="string"),
        "answer_sources": _schema(id="string", bank_id="string", parse_task_id="string", section_key="string", question_index="int", question_anchor="string", answer="string", analysis_text="string", raw_text="string", confidence="double", parse_mode="string", status="string", matched_question_id="string", match_score="double"),
        "action_log": _schema(id="string", question_id="string", action="string", field="string", old_value="string", new_value="string", created_at="timestamp"),
        "system_configs": _schema(key="string", value="string", value_type="string"),
    }


#: Names that a field may have in what arrives; the first that isn't null counts.
ALIASES = {
    "index_num": ("index_num", "index", "indexNum", "question_no"),
    "page_num": ("page_num", "page", "pageNumber"),
    "content": ("content", "stem", "question_text"),
    "material_id": ("material_id", "materialId", "material_temp_id"),
    "images": ("images", "visual_assets", "image_refs"),
}


def resolved(df: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One column for each field, whatever of its names the frame has."""
    aliases = aliases or ALIASES
    used = {n for names in aliases.values() for n in names}
    out = [F.col(c) for c in df.columns if c not in used]
    for field, names in aliases.items():
        own = [F.col(n) for n in names if n in df.columns]
        if own:
            out.append(F.coalesce(*own).alias(field))
    return df.select(*out)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational table, read in parts by a key's range."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options)
    return reader.load()


def alive(df: DataFrame) -> DataFrame:
    """Without soft-deleted rows."""
    return df.where(F.col("deleted_at").isNull())


#: Questions are numbered from here, so left joins meet records of questions before them.
FIRST = 17


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer records, from events."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("ts").alias("created_at"),
        F.get_json_object("props", "$.k").cast("int").alias("question_id"),
        (F.col("event_type") != "error").alias("is_correct"),
        (F.col("value") > 20).alias("is_mastered"),
        (F.col("event_type") == "signup").alias("removed_from_wrong"),
        "value",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of banks and subjects, from part."""
    return read(spark, sf_dir, "part").select((F.col("p_partkey") + FIRST).alias("qid"), F.col("p_brand").alias("bank_id"), F.col("p_type").alias("subject"), F.col("p_name").alias("content"), F.col("p_size").alias("index_num"), F.col("p_retailprice").alias("price"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of pages, from documents: a row for each line that isn't blank, in order, with
    a box of its own."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return text_layer(docs, "doc_id", "text")


def text_layer(pages: DataFrame, page: str, text: str) -> DataFrame:
    """page, line_no (from 0, of lines that aren't blank), line and y0; boxes are [0, y0, 1000,
    y0 + 10] and a line 12 lower than the one before it."""
    kept = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = pages.select(F.col(page).alias("page"), F.posexplode(kept).alias("line_no", "line"))
    return out.withColumn("y0", F.col("line_no") * 12)


def page_indexes(spec: Column) -> Column:
    """``5``, ``1,3`` or ``2-6``, as distinct page numbers in order."""
    one = lambda p: F.when(F.contains(p, F.lit("-")), F.sequence(F.split(p, "-")[0].cast("int"), F.split(p, "-")[1].cast("int"))).otherwise(F.array(p.cast("int")))
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.flatten(F.transform(parts, one)))


def config(table: DataFrame, keys: list[str], defaults: dict[str, str], env: dict[str, str] | None = None) -> dict[str, str]:
    """Settings: from the table, else the environment, else the defaults.  Keys are few."""
    rows = {r["key"]: r["value"] for r in table.where(F.col("key").isin(keys)).select("key", "value").collect()}
    env = env or {}
    return {k: rows.get(k) or env.get(k) or defaults.get(k) for k in keys}


def json_artifact(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON files as rows of a schema; what can't be read is null, a missing file no rows."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def made_records(spark: SparkSession, users: int, days: int = 21, seed: int = 7) -> DataFrame:
    """Made-up records: 6 to 10 a user and day, the same for the same seed."""
    base = spark.range(users * days).select((F.col("id") % users).alias("user_id"), (F.col("id") / users).cast("int").alias("day"))
    h = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30))
    rows = base.withColumn("n", 6 + h("user_id", "day") % 5).select("user_id", "day", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    return rows.select("user_id", "day", "k", (h("user_id", "day", "k") % 1000).alias("question_id"), (h("k", "user_id", "day") % 10 < 7).alias("is_correct"))
