"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import arrays as A
from gradeloom.functions import dates as Dt
from gradeloom.functions import geometry as G
from gradeloom.functions import numeric as N
from gradeloom.functions import text as X
from gradeloom.plans.registry import query
from gradeloom.sources import tables as T


@query(r"""SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short, substr(text, 1, 60) AS prefix,
    upper(trim(source)) AS answer, lower(substr(regexp_replace(regexp_replace(text, '\s+', '', 'g'), '\p{P}', '', 'g'), 1, 500)) AS signature,
    contains(text, 'License') OR contains(text, 'password') AS listed, replace(replace(source, 'src', 's'), '1', '') AS replaced,
    length(regexp_replace(regexp_replace(text, '\s+', '', 'g'), '\p{P}', '', 'g')) AS bare FROM documents""", prelude=False)
def text_scalars(spark, sf_dir):
    t, s = F.col("text"), F.col("source")
    return T.read(spark, sf_dir, "documents").select(
        "doc_id", X.truncated(t).alias("short"), X.prefix(t).alias("prefix"), X.answer(s).alias("answer"), X.signature(t).alias("signature"),
        X.contains_any(t, ["License", "password"]).alias("listed"), X.replaced(F.replace(s, F.lit("src"), F.lit("s")), ["1"]).alias("replaced"),
        F.length(X.signature(t, 1_000_000_000)).cast("long").alias("bare"),
    )


@query(r"""SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS file,
    regexp_replace(regexp_replace(trim(url), '[^a-zA-Z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages""", prelude=False)
def url_scalars(spark, sf_dir):
    return T.read(spark, sf_dir, "pages", "page_id", "url").select("page_id", X.file_name(F.col("url")).alias("file"), X.slug(F.col("url")).alias("slug"))


@query("""SELECT event_id, date_trunc('day', ts) AS day, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, date_trunc('day', ts) - INTERVAL 30 DAY AS month,
    strftime(ts, '%Y-%m-%d') AS iso FROM events""", prelude=False)
def date_scalars(spark, sf_dir):
    t = F.col("ts")
    out = T.read(spark, sf_dir, "events", "event_id", "ts").select("event_id", Dt.start_of_day(t).alias("day"), Dt.start_of_week(t).alias("week"), Dt.period_start("month", t).alias("month"), Dt.iso_date(t).alias("iso"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("day", "week", "month")})


@query("""SELECT p_partkey, CASE WHEN p_size > 0 THEN round(100.0 * (p_partkey % 10) / p_size, 1) ELSE 0.0 END AS pct, round(CAST(p_partkey % 10 AS DOUBLE) / p_size, 4) AS ratio,
    CAST(least(95, greatest(15, round(CAST(p_partkey % 40 AS DOUBLE) / p_size * 90))) AS INTEGER) AS progress,
    coalesce(try_cast(p_name AS DOUBLE), -1.0) AS number, try_cast(substr(p_brand, 7) AS INTEGER) AS whole, least(greatest(p_retailprice / 1000, 0.0), 1.0) AS clamped FROM part""", prelude=False)
def number_scalars(spark, sf_dir):
    k, n = F.col("p_partkey") % 10, F.col("p_size")
    return T.read(spark, sf_dir, "part").select(
        "p_partkey", N.percent(k, n).alias("pct"), N.ratio(k, n).alias("ratio"), N.progress(F.col("p_partkey") % 40, n).alias("progress"),
        N.number_or(F.col("p_name"), -1.0).alias("number"), N.whole_or_null(F.substring("p_brand", 7, 9)).alias("whole"), N.clamp(F.col("p_retailprice") / 1000, 0.0, 1.0).alias("clamped"),
    )


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(0 AS INTEGER) AS broken FROM events""", prelude=False)
def json_scalars(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events", "event_id", "props", "event_type")
    return rows.select("event_id", A.json_object(F.col("props"))["k"].cast("int").alias("k"), F.size(A.json_array(F.col("event_type"))).alias("broken"))


@query(r"""SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS words, len(list_distinct_ordered) AS n FROM (
    SELECT p_partkey, list_filter([p_name, p_brand, p_type, p_brand], lambda x, i: list_position([p_name, p_brand, p_type, p_brand], x) = i) AS list_distinct_ordered FROM part)""", prelude=False)
def array_scalars(spark, sf_dir):
    a = A.distinct_texts(F.array("p_name", "p_brand", F.lit(" "), "p_type", "p_brand", F.lit(None).cast("string")))
    return T.read(spark, sf_dir, "part").select("p_partkey", F.array_join(a, "|").alias("words"), F.size(a).cast("long").alias("n"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_discount * 100 AS d, l_tax * 100 AS x FROM lineitem),
    c AS (SELECT *, least(q + 10, d + 30) - greatest(q, d) AS w, least(20.0 + x, 15.0 + q) - greatest(x, q / 2) AS h FROM b)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN w > 0 AND h > 0 THEN round(w * h / least(greatest(1, 10 * 20.0), greatest(1, 30 * (15.0 + q - q / 2))), 4) ELSE 0.0 END AS overlap,
    CASE WHEN w > 0 THEN round(w / 10.0, 4) ELSE 0.0 END AS in_x, round(greatest(q / 2 - (20.0 + x), x - (15.0 + q), 0.0), 4) AS gap, w > 0 AND h > 0 AS meets FROM c""", prelude=False)
def geometry_scalars(spark, sf_dir):
    q, d, x = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    a, b = G.box(q, x, q + 10, 20.0 + x), G.box(d, q / 2, d + 30, 15.0 + q)
    return T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(G.overlap_ratio(a, b), 4).alias("overlap"), F.round(G.x_overlap(a, b), 4).alias("in_x"), F.round(G.y_gap(a, b), 4).alias("gap"), G.intersects(a, b).alias("meets"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice >= 1500 THEN 'success' WHEN p_retailprice >= 1200 THEN 'warning' ELSE 'danger' END AS bucket FROM part""", prelude=False)
def confidence_bucket(spark, sf_dir):
    c = F.col("p_retailprice") / 1000
    bucket = F.when(c.isNull(), F.lit("info")).when(c >= 1.5, F.lit("success")).when(c >= 1.2, F.lit("warning")).otherwise(F.lit("danger"))
    return T.read(spark, sf_dir, "part").select("p_partkey", bucket.alias("bucket"))
