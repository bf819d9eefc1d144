"""A paper's pages of text in batches of a few, for a parser that takes so much at a time, and
the answers of its last pages.

A question that goes on beyond its batch belongs to the batch in which it begins, so it comes
out of the parser once and whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import arrays as A
from gradeloom.functions import text as X

#: Words of pages of answers, forms of an answer in a key, and their spelling.
ANSWER_PAGE = ("参考答案", "答案解析", "答题详解", "答案与解析", "参考答案及解析")
KEY_FORMS = (r"(\d{1,3})[．.、]\s*([ABCD对错√×正确错误])", r"[（(](\d{1,3})[）)]\s*([ABCD对错√×])")
SPELLING = {"√": "对", "×": "错", "正确": "对", "错误": "错"}
#: A question's mark at a line's start.
MARK = r"^\s*(?:【\s*例\s*\d{1,4}\s*】|例题\s*\d{1,4}|第\s*\d{1,4}\s*题|\d{1,4}\s*[．.。]\s|\d{1,4}\s*[、)])"


def with_answer_start(pages: DataFrame) -> DataFrame:
    """``pages`` (doc, page from 0, text) with answer_start: the last page, of the document's
    last 19, that speaks of answers; null if there is none or if it is the first."""
    own = Window.partitionBy("doc")
    out = pages.withColumn("_total", F.max("page").over(own) + 1)
    says = X.contains_any(F.coalesce("text", F.lit("")), list(ANSWER_PAGE)) & (F.col("page") > F.greatest(F.col("_total") - 20, F.lit(-1)))
    found = F.max(F.when(says, F.col("page"))).over(own)
    return out.withColumn("answer_start", F.when(found > 0, found)).drop("_total")


def _joined(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("text"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("text"))


def batches(pages: DataFrame, size: int = 5, least: int = 100, mark: str = MARK) -> DataFrame:
    """doc, batch (from 0) and text of the pages before the answers, ``size`` pages a batch.

    What stands before a batch's first mark goes on the last batch before it that has one;
    where none has, it stays.  Batches of less than ``least`` characters are left out."""
    content = with_answer_start(pages).where(F.col("answer_start").isNull() | (F.col("page") < F.col("answer_start")))
    whole = _joined(content.withColumn("batch", F.floor(F.col("page") / size).cast("int")), ["doc", "batch"], "page")
    whole = whole.withColumn("_at", F.regexp_instr("text", F.lit(f"(?Um){mark}")))
    order = Window.partitionBy("doc").orderBy("batch")
    before = F.last(F.when(F.col("_at") > 0, F.col("batch")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    owned = whole.withColumn("_before", F.coalesce(before, F.col("batch")))
    head = F.when(F.col("_at") > 0, F.substring("text", F.lit(1), F.col("_at") - 1)).otherwise(F.col("text"))
    head = F.struct(F.col("_before").alias("owner"), F.regexp_replace(head, r"\n\z", "").alias("text"), (F.col("batch") * 2).alias("n"))
    rest = F.when(F.col("_at") > 0, F.struct(F.col("batch").alias("owner"), F.expr("substring(text, _at)").alias("text"), (F.col("batch") * 2 + 1).alias("n")))
    pieces = owned.select("doc", F.explode(F.array_compact(F.array(F.when(F.col("_at") != 1, head), rest))).alias("_p")).select("doc", F.col("_p.owner").alias("batch"), "_p.text", "_p.n")
    out = _joined(pieces, ["doc", "batch"], "n")
    return out.where(F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) >= least)


def answer_keys(pages: DataFrame) -> DataFrame:
    """doc and key, the answers by number that the pages from answer_start on state; of repeats
    the first counts, the first form's before the second's."""
    last = with_answer_start(pages)
    text = _joined(last.where(F.col("page") >= F.col("answer_start")), ["doc"], "page")

    def pairs(form: str) -> Column:
        numbers, answers = (F.regexp_extract_all("text", F.lit(form), F.lit(g)) for g in (1, 2))
        spelt = lambda v: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SPELLING.items() for x in kv]), v), v)
        return F.zip_with(numbers, answers, lambda k, v: F.struct(k.cast("int").alias("key"), spelt(v).alias("value")))

    return text.select("doc", A.first_wins(F.concat(*[pairs(f) for f in KEY_FORMS])).alias("key"))


def parsed(pages: DataFrame, parse: Callable[[DataFrame], DataFrame], size: int = 5, mark: str = MARK) -> DataFrame:
    """What ``parse`` makes of the batches (doc, index, answer and others), with the key's
    answers where it gives none."""
    out = parse(batches(pages, size, mark=mark)).join(answer_keys(pages), "doc", "left")
    own = F.nullif(F.trim("answer"), F.lit(""))
    return out.withColumn("answer", F.coalesce(own, F.col("key")[F.col("index")])).drop("key")
