"""Figures, tables and equations: ids, boxes, captions, contexts.

Boxes are columns left, top, right, bottom in points; blocks rows (doc_id, page_no, pos, text, kind, box).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import constants as C
from papyrine.functions.text import caption_id, caption_kind, clean_latex, latex_id, let, repair_table, strip


def detections(found: DataFrame) -> DataFrame:
    """Detections (doc_id, page_no, det_seq, class, box) of figures, images and tables with pool, number, id and file name.

    Figures and images share a counter, tables have their own, both over the whole document.
    """
    pool = F.when(F.col("class") == "table", "table").otherwise("figure")
    kept = found.where(F.col("class").isin("figure", "image", "table")).withColumn("pool", pool)
    n = F.row_number().over(Window.partitionBy("doc_id", "pool").orderBy("page_no", "det_seq"))
    named = kept.withColumn("n", n)
    return named.withColumn("id", F.concat(F.initcap("pool"), F.lit(" "), F.col("n").cast("string"))).withColumn(
        "file", F.concat(F.substring("pool", 1, 3), F.lit("_"), F.col("n").cast("string"), F.lit("_p"), F.col("page_no").cast("string"), F.lit(".png"))
    )


def captions(blocks: DataFrame) -> DataFrame:
    """Text blocks that open with a caption label, with kind, id and pool."""
    told = blocks.where("kind = 'text' and text <> ''").withColumn("caption_kind", caption_kind("text")).where("caption_kind is not null")
    return told.withColumn("caption_id", caption_id("text")).withColumn("pool", F.when(F.col("caption_kind") == "Table", "table").otherwise("figure"))


def caption_distance(v, c) -> Column:
    """Vertical gap of two boxes plus their horizontal gap where they do not overlap."""
    overlap = F.least(v["right"], c["right"]) - F.greatest(v["left"], c["left"])
    gap = F.when(c["top"] >= v["bottom"], c["top"] - v["bottom"]).when(c["bottom"] <= v["top"], v["top"] - c["bottom"]).otherwise(F.lit(0.0))
    return gap + F.when(overlap > 0, F.lit(0.0)).otherwise(-overlap)


def nearest_captions(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each item with its nearest caption of the page and pool, without regard to other items."""
    key = ["doc_id", "page_no", "pool"]
    c = candidates.select(*key, F.struct("pos", "caption_id", "text", "left", "top", "right", "bottom").alias("c"))
    near = items.join(c, key).withColumn("dist", caption_distance({k: F.col(k) for k in ("left", "top", "right", "bottom")}, F.col("c"))).where(F.col("dist") < C.CAPTION_REACH)
    return near.groupBy(*key, "n").agg(F.min_by(F.struct("c.caption_id", "dist"), F.struct("dist", "c.pos")).alias("_b")).select(*key, "n", "_b.caption_id", "_b.dist")


def assign_captions(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Items with the captions they get: each in turn takes the nearest one left of its page and pool, within reach.

    One fold a page and pool; its state holds the captions used, so an item never takes another's.
    """
    key = ["doc_id", "page_no", "pool"]
    box = ("left", "top", "right", "bottom")
    wanted = items.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("n", *box))).alias("_items"))
    offered = candidates.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "caption_id", "text", *box))).alias("_offers"))
    both = wanted.join(offered, key)
    none = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<n:int,pos:int>>").alias("out"))

    def step(s: Column, v: Column) -> Column:
        near = F.transform(F.filter("_offers", lambda c: ~F.array_contains(s["used"], c["pos"]) & (caption_distance(v, c) < C.CAPTION_REACH)), lambda c: F.struct(caption_distance(v, c).alias("d"), c["pos"].alias("pos")))
        pick = F.get(F.transform(F.array(F.array_min(near)), lambda m: m["pos"]), F.lit(0))
        return F.get(
            F.transform(F.array(pick), lambda p: F.struct(F.when(p.isNull(), s["used"]).otherwise(F.concat(s["used"], F.array(p))).alias("used"), F.when(p.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(v["n"].alias("n"), p.alias("pos"))))).alias("out"))),
            F.lit(0),
        )

    def named(o: Column) -> Column:
        offer = F.get(F.filter("_offers", lambda c: c["pos"] == o["pos"]), F.lit(0))
        return let(offer, lambda c: F.struct(o["n"].alias("n"), c["caption_id"].alias("new_id"), c["text"].alias("caption")))

    got = both.select(*key, F.inline(F.transform(F.aggregate("_items", none, step, lambda s: s["out"]), named)))
    return items.join(got, [*key, "n"], "left").withColumn("id", F.coalesce("new_id", "id")).withColumn("caption", F.coalesce("caption", F.lit(""))).drop("new_id")


def equation_context(equations: DataFrame, blocks: DataFrame, slack: float = C.CONTEXT_SLACK) -> DataFrame:
    """Equations (doc_id, page_no, eq_no, top, bottom, ...) with the text blocks nearest above and below, joined by a mark.

    Above: bottom edge at most `slack` below the equation's top, the lowest; below likewise, the highest; the first in
    order on ties. An equation without box or text on its page keeps its context.
    """
    told = blocks.where("kind = 'text' and text <> ''").select("doc_id", "page_no", F.struct("pos", "text", "top", "bottom").alias("b"))
    key = ["doc_id", "page_no", "eq_no"]
    near = equations.select(*key, F.col("top").alias("_t"), F.col("bottom").alias("_b")).join(told, ["doc_id", "page_no"])
    above, below = F.col("b.bottom") <= F.col("_t") + slack, F.col("b.top") >= F.col("_b") - slack
    best = near.groupBy(*key).agg(
        F.max_by(F.when(above, F.col("b.text")), F.when(above, F.struct(F.col("b.bottom"), -F.col("b.pos")))).alias("up"),
        F.min_by(F.when(below, F.col("b.text")), F.when(below, F.struct(F.col("b.top"), F.col("b.pos")))).alias("down"),
    )
    context = F.when(F.col("up").isNotNull() | F.col("down").isNotNull(), F.concat_ws(C.PLACEHOLDER, strip("up"), strip("down")))
    return equations.join(best.select(*key, context.alias("context")), key, "left")


def crop_boxes(found: DataFrame, zoom: float = C.EQUATION_ZOOM, pad: int = C.CROP_PAD) -> DataFrame:
    """Detector boxes (x1, y1, x2, y2 in pixels, img_w, img_h): padded, clamped, tiny crops dropped; back in points."""
    x1, y1 = F.greatest(F.lit(0.0), F.col("x1") - pad), F.greatest(F.lit(0.0), F.col("y1") - pad)
    x2, y2 = F.least(F.col("img_w"), F.col("x2") + pad), F.least(F.col("img_h"), F.col("y2") + pad)
    kept = found.where((x2 - x1 >= 20) & (y2 - y1 >= 10))
    order = Window.partitionBy("doc_id").orderBy("page_no", "y1", "det_seq")
    return kept.withColumn("eq_no", F.row_number().over(order)).select("*", *[F.bround(F.col(c) / zoom, 2).alias(n) for c, n in (("x1", "left"), ("y1", "top"), ("x2", "right"), ("y2", "bottom"))])


def equations(crops: DataFrame, ocr_available: bool = True) -> DataFrame:
    """Crops with raw_latex to equations with clean latex and id; without LaTeX they go if an engine was there to read it."""
    told = crops.withColumn("latex", F.coalesce(clean_latex("raw_latex"), F.lit("")))
    kept = told.where("latex <> ''") if ocr_available else told
    return kept.withColumn("id", latex_id("latex"))


def read_tables(items: DataFrame, replies: DataFrame | None) -> DataFrame:
    """Items with `data`, the cells of tables that a vision model's replies (doc_id, file, reply) hold; else none."""
    none = F.array().cast("array<array<string>>")
    if replies is None:
        return items.withColumn("data", none)
    cells = replies.select("doc_id", "file", repair_table("reply").alias("data"))
    return items.join(cells, ["doc_id", "file"], "left").withColumn("data", F.coalesce("data", none))
