"""Bottom-k sketches of shingle hashes, in column expressions only.

A text's sketch is the ``K`` least distinct hashes of its five-word shingles (with fewer
words, of the whole sequence), 48 bits each, ascending; a text without words has the empty
sketch.  Sketches of parts merge into the sketch of the whole.  They estimate resemblance
(of the k least of the union, the share in both), containment and the number of distinct
shingles (exact below k).  Printed, a sketch is base64 of its hashes, 6 bytes each.

Words are runs of what isn't ASCII white space, lower-cased.

Cases: a null text is empty.  Two empty sketches resemble each other fully (1), an empty and
another one not at all (0).  Null doc_ids come first, equal ones in the order of their texts'
hashes (then lengths); the only document is its own next.  No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import WORD_GAP, written

K = 64
WORDS = 5
BITS = 48
DIGITS = BITS // 4


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")


def hashes(text: Column, n: int = WORDS) -> Column:
    """All shingle hashes of a text, with repeats."""
    own = F.transform(words(text), lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        last = F.size(w) - n
        many = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + k) for k in range(n)]), 64 - BITS),
        )
        return F.when(F.size(w) > 0, many).otherwise(F.array().cast("array<bigint>"))

    # the words' hashes are bound once, not once a shingle
    return F.element_at(F.transform(F.array(own), shingles), 1)


def sketch(text: Column, k: int = K) -> Column:
    return least(hashes(text), k)


def least(values: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(values)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the whole from its parts' sketches."""
    return least(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    def of(x: Column) -> Column:
        both = F.array_intersect(F.array_intersect(x["a"], x["b"]), x["u"])
        return F.when(F.size(x["u"]) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(x["u"]))

    bound = F.array(F.struct(a.alias("a"), b.alias("b"), merge(a, b, k).alias("u")))
    return F.element_at(F.transform(bound, of), 1)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact if the sketch is not full; else (k - 1) over the k-th least hash's place."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(2**BITS)) / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """How much of a's shingles b has, from resemblance and the two counts."""
    r = resemblance(a, b, k)
    both = r * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def printed(a: Column) -> Column:
    return text_of(packed(a))


def text_of(data: Column) -> Column:
    """Base64 on one line."""
    return F.translate(F.base64(data), "\r\n", "")


def packed(a: Column) -> Column:
    """A sketch as bytes, a hash after another."""
    return F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), DIGITS, "0")), ""))


def unpacked(data: Column) -> Column:
    digits = F.hex(data)
    one = lambda i: F.conv(F.substr(digits, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("bigint")
    return F.when(F.length(data) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.length(data) / (BITS // 8) - 1, F.lit(0)).cast("int")), one)).otherwise(F.array().cast("array<bigint>"))


#: What tells documents apart: rows that agree in all of these have the same text.
KEY = ("null", "id", "hash", "chars")


def linked(keys: DataFrame) -> DataFrame:
    """For each key (distinct, with its number of rows, n) the one before it in ascending order,
    as to_... (before the first: the last).

    Keys are dealt by range; each part's last is carried over to the part after it, so no
    task needs more than its part and one row a part.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("null"), *(F.asc(c) for c in KEY[1:])]
    # the parts' bounds are drawn once
    ranged = written(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    own = F.struct((~F.col("null")).alias("known"), *KEY[1:])
    last = ranged.groupBy("part").agg(F.max(own).alias("last"))
    every = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = last.select("part", F.coalesce(F.lag("last").over(every), F.last("last").over(whole)).alias("carried"))
    within = Window.partitionBy("part").orderBy(*order)
    before = ranged.withColumn("_lag", F.lag(own).over(within)).join(F.broadcast(carried) if parts <= 10_000 else carried, "part")
    before = before.withColumn("before", F.coalesce("_lag", "carried"))
    return before.select(*KEY, "n", (~F.col("before.known")).alias("to_null"), *[F.col(f"before.{c}").alias(f"to_{c}") for c in KEY[1:]])


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with n_chars, sketch (packed), and of the next document its
    sketch and its first n_chars / 2 code points.

    Texts are dealt once by their key; what the document before needs of them, once more.  Of
    rows that are alike each but the last has the same text next, and one stands for all.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").cast("long").isNull().alias("null"), F.xxhash64(text).alias("hash"), F.length(text).alias("chars"), text.alias("text"))
    links = linked(docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")))
    own = docs.select(*KEY, "text", packed(sketch(F.col("text"))).alias("sketch"))
    alike = Window.partitionBy(*KEY).orderBy(F.lit(0))
    joined = own.withColumn("number", F.row_number().over(alike)).join(links, list(KEY))
    # a document's beginning for the one before it; said so that no limit of the window is put
    # before the dealing, which would then not be the one that serves both sides
    nexts = joined.where(F.col("number") * 2 == 2).select(
        *[F.col(f"to_{c}").alias(f"_{c}") for c in KEY],
        F.substring("text", F.lit(1), F.floor(F.col("to_chars") / 2).cast("int")).alias("next_text"),
        F.col("sketch").alias("next_sketch"),
    )
    same = [F.col(c) == F.col(f"_{c}") for c in KEY]
    last = F.col("number") == F.col("n")
    doc_id = F.when(~F.col("null"), F.col("id")).alias("doc_id")
    return joined.join(nexts, same).select(
        doc_id,
        "text",
        F.col("chars").cast("long").alias("n_chars"),
        "sketch",
        F.when(last, F.col("next_text")).otherwise(F.col("text")).alias("next_text"),
        F.when(last, F.col("next_sketch")).otherwise(F.col("sketch")).alias("next_sketch"),
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, the last half of which is
    the next document's beginning, and their likeness and the next document's."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", packed(sketch(F.col("edited"))).alias("edited_sketch"), "next_sketch")
    mine, other, after = (unpacked(F.col(c)) for c in ("sketch", "edited_sketch", "next_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of(F.col("sketch")).alias("fingerprint"),
        text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(mine, other).cast("double").alias("near_edited"),
        resemblance(mine, after).cast("double").alias("near_next"),
    )
