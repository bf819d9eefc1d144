"""Questions grouped under the material or visual above them, and the summary of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import geometry as G

# fixed values
_FAILED = ("vision_page_timeout", "visual_model_failed")


def _groups(rows: DataFrame) -> DataFrame:
    """Rows (page, seed, link_reason, sure, seed's place, question's place) as groups."""
    low = lambda k: F.min(F.least(F.col("s.bbox")[k], F.col("q.bbox")[k]))
    high = lambda k: F.max(F.greatest(F.col("s.bbox")[k], F.col("q.bbox")[k]))
    return rows.groupBy("page", "seed").agg(
        F.array(low(0), low(1), high(2), high(3)).alias("bbox"),
        F.transform(F.array_sort(F.collect_list(F.struct("q.y0", "q.index"))), lambda x: x["index"]).alias("question_indexes"),
        F.min("q.y0").alias("first_y"), F.max("q.y1").alias("last_y"), F.first("s").alias("s"),
    )


def material_groups(questions: DataFrame, seeds: DataFrame) -> DataFrame:
    """Groups of a page's questions: those that name a material, and those between a seed and
    the next one down the page.

    questions: page, index, y0, y1, bbox, material_key.  seeds: page, seed (unique in a page),
    type (material or visual), material_key, y0, y1, bbox, page_height; seeds without a valid
    box take no part.  A material that questions name takes no others, but still ends the reach
    of the seed above it.  A seed whose first question is too far below is ``uncertain``.

    Returns page, seed, link_reason, question_indexes, bbox, start_y, end_y, confidence,
    warnings, uncertain, group_id (numbered down the page, named materials first; null if
    uncertain).  A question stands below one seed only, so one sort of both finds it."""
    own = seeds.where(G.valid(F.col("bbox")))
    place = F.struct("type", "material_key", "y0", "y1", "bbox", "page_height")
    s = own.select("page", "seed", place.alias("s"))
    q = questions.select("page", F.struct("index", "y0", "y1", F.when(G.valid(F.col("bbox")), F.col("bbox")).alias("bbox")).alias("q"), "material_key")

    materials = s.where(F.col("s.type") == "material").withColumn("material_key", F.col("s.material_key"))
    named = _groups(materials.join(q, ["page", "material_key"]))
    named = named.withColumns({"explicit": F.lit(True), "start_y": F.least("s.y0", "first_y"), "end_y": F.greatest("s.y1", "last_y")})

    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    both = s.withColumns({"y0": F.col("s.y0"), "y1": F.col("s.y1"), "q": nothing(q, "q")}).unionByName(
        q.select("page", "q", F.col("q.y0").alias("y0"), F.col("q.y1").alias("y1"), nothing(s, "seed").alias("seed"), nothing(s, "s").alias("s"))
    )
    above = Window.partitionBy("page").orderBy("y0", F.col("q").isNotNull(), "y1").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("q").isNull(), F.struct("seed", "s")), ignorenulls=True).over(above)
    under = both.withColumn("_last", last).where(F.col("q").isNotNull()).select("page", "q", "_last.*").where(F.col("q.y0") >= F.col("s.y1"))
    down = _groups(under).join(named.select("page", "seed"), ["page", "seed"], "left_anti")
    down = down.withColumns({"explicit": F.lit(False), "start_y": F.col("s.y0"), "end_y": F.col("last_y")})

    out = named.unionByName(down)
    many = F.size("question_indexes") > 1
    far = ~F.col("explicit") & (F.col("first_y") - F.col("s.y1") > G.most_gap(F.col("s.page_height")))
    order = Window.partitionBy("page", "uncertain").orderBy(F.col("explicit").desc(), "s.y0", "s.y1", "seed")
    out = out.withColumns({
        "uncertain": far,
        "link_reason": F.when(F.col("explicit"), F.lit("explicit_material_group")).otherwise(F.concat(F.lit("downward_"), "s.type", F.lit("_group"))),
        "confidence": F.when(~many, 0.72).when(F.col("explicit"), 0.9).otherwise(0.86),
        "warnings": F.when(far, F.array(F.lit("material_group_range_uncertain"))).when(many, F.array().cast("array<string>")).otherwise(F.array(F.lit("material_group_low_confidence"))),
    })
    number = F.row_number().over(order)
    out = out.withColumn("group_id", F.when(~F.col("uncertain"), F.format_string("mg_p%s_%s", F.col("page"), number)))
    return out.select("page", "seed", "link_reason", "question_indexes", "bbox", "start_y", "end_y", "confidence", "warnings", "uncertain", "group_id")


def run_summary(pages: DataFrame, run: str, questions: Column) -> DataFrame:
    """One row a run: pages (page_num, request_status, page_warnings) tried, the indexes (from
    0) of those that ran out of time and of those that failed, and ``questions`` found."""
    has = lambda *w: F.coalesce(F.arrays_overlap("page_warnings", F.array(*[F.lit(x) for x in w])), F.lit(False))
    index = F.col("page_num") - 1
    failed = F.coalesce(F.col("request_status") == "failed", F.lit(False)) | has(*_FAILED)
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, index)))
    return pages.groupBy(run).agg(
        F.count(F.lit(1)).alias("pages_attempted"), listed(has(_FAILED[0])).alias("timeout_pages"), listed(failed).alias("failed_pages"),
        F.coalesce(F.sum(questions), F.lit(0)).alias("visual_question_candidates"),
    )
