"""Golden cases: small files of ``key: value`` lines, with questions two steps in, many at once.

Lines are rows, with the section and the question they stand in from running windows; what
comes out are entries, a row a key, and the first line that fits nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a question's lists are called.
LISTS = ("expected_visuals", "expected_content_texts", "expected_child_visuals", "expected_absorbed_texts", "must_not_overlap_visuals")


def told(files: DataFrame) -> DataFrame:
    """A row for each line of ``files`` (path, unique, and text): path, n (from 0), question, key
    and value of the entry it makes, told, whether it makes one, and fault, if it fits nowhere.

    The section and the question that a line stands in are those of the last line before it
    that began one: running windows over a file's lines, which stream by."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("n", "_x")
    text = F.regexp_replace(F.substring_index("_x", "#", 1), r"(?U)\s+$", "")
    bare = F.regexp_replace("_t", r"(?U)^\s+", "")
    indent = F.length("_t") - F.length(F.regexp_replace("_t", "^ +", ""))
    b = F.col("_b")
    key = F.trim(F.substring_index(b, ":", 1))
    value = F.nullif(F.trim(F.substring(b, F.locate(":", b) + 1, F.length(b))), F.lit(""))
    rows = files.select("path", lines).withColumn("_t", text).withColumns({"_b": bare, "_indent": indent})
    rows = rows.select("path", "n", "_x", "_b", "_indent", key.alias("_k"), value.alias("_v"), F.contains(b, F.lit(":")).alias("_has_key"))
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    top = (F.col("_indent") == 0) & F.col("_has_key")
    rows = rows.withColumn("_section", last(F.when(top, F.struct(F.when(F.col("_v").isNull(), F.col("_k")).alias("name")))))
    inside = F.col("_section.name").eqNullSafe("questions")
    opens = inside & (F.col("_indent") == 2) & b.endswith(":")
    opened = F.substring(b, F.lit(1), F.length(b) - 1)
    begun = F.when(opens, F.struct(opened.alias("name"))).when(top, F.struct(F.lit(None).cast("string").alias("name")))
    rows = rows.withColumn("_question", last(begun))
    own = inside & (F.col("_indent") >= 4) & F.col("_question.name").isNotNull() & F.col("_has_key") & ~opens
    makes = opens | ((top | own) & F.col("_v").isNotNull())
    question = F.when(opens, opened).when(~top, F.col("_question.name"))
    fault = F.when((b != "") & ~(top | opens | own), F.concat(F.lit("Unsupported case line: "), "_x"))
    return rows.select("path", "n", question.alias("question"), F.when(~opens, F.col("_k")).alias("key"), F.when(~opens, F.col("_v")).alias("value"), makes.alias("told"), fault.alias("fault"))


def _names(name: str) -> Column:
    """Whether one of a file's entries, outside of its questions, has this key."""
    return F.coalesce(F.bool_or(F.col("told") & F.col("question").isNull() & (F.col("key") == name)), F.lit(False))


def parsed(files: DataFrame) -> DataFrame:
    """``files`` (path and text) with entries and fault: what is wrong with a file, or null."""
    entry = F.struct("n", "question", "key", "value")
    out = told(files).groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("told"), entry))).alias("entries"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("n"))).alias("fault"), (_names("name") & _names("pdf")).alias("_named"))
    fault = F.coalesce("fault", F.when(~F.col("_named"), F.lit("case must define name and pdf")))
    return out.select("path", "entries", fault.alias("fault"))


def sound(files: DataFrame) -> DataFrame:
    """path, n, question, key and value of all entries of files without a fault, a row each, so
    that no file's are gathered."""
    rows = told(files)
    verdict = rows.groupBy("path").agg((F.count("fault") == 0).alias("_sound"), (_names("name") & _names("pdf")).alias("_named"))
    good = verdict.where(F.col("_sound") & F.col("_named")).select("path")
    return rows.where("told").join(good, "path", "left_semi").select("path", "n", "question", "key", "value")


def _bare(value: Column) -> Column:
    """A scalar's text, without the quotes around it."""
    quoted = F.rlike(value, F.lit("^\".*\"$|^'.*'$")) & (F.length(value) > 1)
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def listed(value: Column) -> Column:
    """The texts of a list ``[a, b]``; null if it is none."""
    inner = F.trim(F.substring(value, F.lit(2), F.length(value) - 2))
    parts = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda x: _bare(F.trim(x))))
    return F.when(F.rlike(value, F.lit(r"^\[.*\]$")), parts)


def expectations(cases: DataFrame) -> DataFrame:
    """Of ``parsed`` files without a fault, what each question is expected to have (``expected``)."""
    return expected(cases.where(F.col("fault").isNull()).select("path", F.inline("entries")))


def expected(rows: DataFrame) -> DataFrame:
    """Of ``sound`` entries, what each question is expected to have: layout (the
    case's name), question, index, the ``LISTS`` and must_not_overlap_questions, as indexes: a
    name stands for its question's in the same file.  Of a repeated key or question the last
    counts."""
    name = rows.where(F.col("question").isNull() & (F.col("key") == "name")).groupBy("path").agg(F.max_by(_bare(F.col("value")), "n").alias("layout"))
    own = rows.where(F.col("question").isNotNull())
    begun = F.max(F.when(F.col("key").isNull(), F.col("n"))).over(Window.partitionBy("path", "question"))
    own = own.withColumn("_begun", begun).where(F.col("n") >= F.col("_begun"))
    last = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("n")))
    out = own.groupBy("path", "question").agg(last("index").try_cast("int").alias("index"), *[listed(last(k)).alias(k) for k in LISTS], listed(last("must_not_overlap_questions")).alias("_others"))
    each = out.select("path", "question", F.explode("_others").alias("_other"))
    known = out.select("path", F.col("question").alias("_other"), F.col("index").alias("_index"))
    met = each.join(known, ["path", "_other"], "left").groupBy("path", "question").agg(F.sort_array(F.collect_list(F.coalesce("_index", F.col("_other").try_cast("int")))).alias("must_not_overlap_questions"))
    return out.drop("_others").join(met, ["path", "question"], "left").join(name, "path").drop("path")
