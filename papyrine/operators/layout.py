"""From raw page blocks to text and image blocks in reading order.

Raw blocks are rows (doc_id, page_no, seq, page_w, page_h, type, x0, y0, x1, y1, lines); type 0 is text, 1 an image, and
seq the order in the page. All windows share the keys (doc_id, page_no), so one exchange serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import constants as C
from papyrine.functions.text import clean_text, strip

SPAN = "struct<text:string,size:double,x0:double,x1:double,flags:int,font:string>"
LINE = f"struct<x0:double,y0:double,x1:double,y1:double,spans:array<{SPAN}>>"
RAW = f"doc_id long, page_no int, seq int, page_w double, page_h double, type int, x0 double, y0 double, x1 double, y1 double, lines array<{LINE}>"


def keep_blocks(raw: DataFrame, margin: float = C.MARGIN) -> DataFrame:
    """Text and image blocks only; text blocks in the header or footer band go."""
    banded = (F.col("type") == 0) & ((F.col("y0") < margin) | (F.col("y1") > F.col("page_h") - margin))
    return raw.where(F.col("type").isin(0, 1) & ~banded)


def zones(blocks: DataFrame, spanning: float = C.SPANNING) -> DataFrame:
    """Adds `spanning` and `zone`: a spanning block is a zone of its own, the blocks between two of them share one."""
    down = Window.partitionBy("doc_id", "page_no").orderBy("y0", "seq")
    wide = (F.col("x1") - F.col("x0")) > F.col("page_w") * spanning
    marked = blocks.withColumn("spanning", wide)
    return marked.withColumn("zone", 2 * F.sum(F.col("spanning").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("spanning").cast("int"))


def columns_of_zones(zoned: DataFrame, tolerance: float = C.COLUMN_TOLERANCE) -> DataFrame:
    """(doc_id, page_no, zone, col, left, right): the union of the x-intervals of a zone's blocks, left to right."""
    across = Window.partitionBy("doc_id", "page_no", "zone").orderBy("x0", "seq")
    reach = zoned.withColumn("reach", F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1)))
    island = reach.withColumn("col", F.sum(F.coalesce((F.col("x0") > F.col("reach") + tolerance).cast("int"), F.lit(0))).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "page_no", "zone", "col").agg(F.min("x0").alias("left"), F.max("x1").alias("right"))


def union_of_intervals(spans: Column, tolerance: float = C.COLUMN_TOLERANCE) -> Column:
    """Array of (left, right): the union of intervals (x0, seq, x1) sorted by x0, where one at most `tolerance` off joins."""
    none = F.array().cast("array<struct<left:double,right:double>>")

    def add(s: Column, x: Column) -> Column:
        last = F.get(s, F.size(s) - 1)
        opens = (F.size(s) == 0) | (x["x0"] > last["right"] + tolerance)
        fresh = F.array(F.struct(x["x0"].alias("left"), x["x1"].alias("right")))
        wider = F.array(F.struct(last["left"].alias("left"), F.greatest(last["right"], x["x1"]).alias("right")))
        return F.when(opens, F.concat(s, fresh)).otherwise(F.concat(F.slice(s, 1, F.size(s) - 1), wider))

    return F.aggregate(spans, none, add)


def reading_order(zoned: DataFrame, tolerance: float = C.COLUMN_TOLERANCE, slack: float = C.BLOCK_TOLERANCE) -> DataFrame:
    """Adds `col` and `pos`: zone by zone, column by column, downwards.

    A block belongs to the first column whose interval, widened by `slack`, holds its left edge; to the first otherwise.
    The columns are folded in windows over the zone, which the exchange by page serves already: no join, no second scan.
    """
    zone = Window.partitionBy("doc_id", "page_no", "zone")
    spans = zoned.withColumn("_spans", F.sort_array(F.collect_list(F.struct("x0", "seq", "x1")).over(zone)))
    numbered = F.transform(union_of_intervals(F.col("_spans"), tolerance), lambda c, i: F.struct(i.alias("i"), c["left"].alias("left"), c["right"].alias("right")))
    fits = F.filter(numbered, lambda c: F.col("x0").between(c["left"] - slack, c["right"] + slack))
    placed = spans.withColumn("col", F.coalesce(F.get(fits, F.lit(0))["i"], F.lit(0))).drop("_spans")
    order = Window.partitionBy("doc_id", "page_no").orderBy("zone", "col", "y0", "seq")
    return placed.withColumn("pos", F.row_number().over(order))


def line_text(spans: Column, gap: float = C.SPAN_GAP) -> Column:
    """Text of a line: spans in order, a blank where one starts over `gap` points behind the one before."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(F.concat(s["text"], F.when(x["x0"] - s["end"] > gap, F.lit(" ")).otherwise(F.lit("")), F.coalesce(x["text"], F.lit(""))).alias("text"), x["x1"].alias("end")),
        lambda s: s["text"],
    )


def line_font(spans: Column) -> Column:
    return F.array_max(F.transform(spans, lambda s: s["size"]))


def line_bold(spans: Column) -> Column:
    return F.exists(spans, lambda s: (F.coalesce(s["flags"], F.lit(0)).bitwiseAND(F.lit(16)) != 0) | F.contains(F.lower(F.coalesce(s["font"], F.lit(""))), F.lit("bold")))


def runs_of_lines(lines: Column, step: float = C.FONT_STEP) -> Column:
    """Array of lines with a run number: a line opens a run if its font is over `step` off, or its weight differs from,
    the first line of the current run. Input: structs (text, font, bold, x0, y0, x1, y1)."""
    none = F.struct(F.lit(None).cast("double").alias("font"), F.lit(None).cast("boolean").alias("bold"), F.lit(0).alias("run"), F.array().cast("array<int>").alias("runs"))

    def step_on(s: Column, x: Column) -> Column:
        opens = s["font"].isNull() | (F.abs(s["font"] - x["font"]) > step) | (s["bold"] != x["bold"])
        run = s["run"] + opens.cast("int")
        return F.struct(F.when(opens, x["font"]).otherwise(s["font"]).alias("font"), F.when(opens, x["bold"]).otherwise(s["bold"]).alias("bold"), run.alias("run"), F.concat(s["runs"], F.array(run)).alias("runs"))

    return F.aggregate(lines, none, step_on, lambda s: s["runs"])


def long_enough(text: Column) -> Column:
    """Text of over three characters, blanks around it not counted."""
    return F.length(strip(text)) > C.SHORTEST_TEXT


def split_runs(placed: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_no, pos, text, font, bold, left, top, right, bottom, kind), one for each run of like lines.

    Runs of three characters or fewer go; text is cleaned, font rounded to tenths. Images keep their box and no text.
    """
    lines = F.transform(
        F.filter(F.coalesce("lines", F.array().cast(f"array<{LINE}>")), lambda l: F.size(l["spans"]) > 0),
        lambda l: F.struct(line_text(l["spans"]).alias("text"), line_font(l["spans"]).alias("font"), line_bold(l["spans"]).alias("bold"), l["x0"].alias("x0"), l["y0"].alias("y0"), l["x1"].alias("x1"), l["y1"].alias("y1")),
    )
    keyed = placed.select("doc_id", "page_no", "pos", "type", "x0", "y0", "x1", "y1", lines.alias("_lines"))
    ran = keyed.withColumn("_runs", runs_of_lines(F.col("_lines")))
    image = F.col("type") == 1  # one row, as if it were a run
    one = ran.withColumn("run", F.explode(F.when(image, F.array(F.lit(0))).otherwise(F.array_distinct("_runs"))))
    own = F.transform(F.filter(F.arrays_zip(F.col("_lines").alias("l"), F.col("_runs").alias("r")), lambda z: z["r"] == F.col("run")), lambda z: z["l"])
    raw_text = strip(F.array_join(F.transform("_own", lambda l: l["text"]), "\n"))
    parts = one.withColumn("_own", own).withColumn("_text", F.when(~image, raw_text)).where(image | long_enough(F.col("_text")))
    first = F.get("_own", F.lit(0))
    box = lambda f, c: F.when(image, F.col(c)).otherwise(f(F.col("_own")[c]))
    every = parts.select(
        "doc_id", "page_no", "pos", "run", clean_text("_text").alias("text"), F.when(~image, F.bround(first["font"], 1)).alias("font"), F.when(image, F.lit(False)).otherwise(first["bold"]).alias("bold"),
        *[box(f, k).alias(n) for f, k, n in ((F.array_min, "x0", "left"), (F.array_min, "y0", "top"), (F.array_max, "x1", "right"), (F.array_max, "y1", "bottom"))],
        F.when(image, "image").otherwise("text").alias("kind"),
    )
    order = Window.partitionBy("doc_id").orderBy("page_no", "pos", "run")
    return every.withColumn("pos", F.row_number().over(order)).drop("run")


def page_blocks(raw: DataFrame, col_tolerance: float = C.COLUMN_TOLERANCE, block_tolerance: float = C.BLOCK_TOLERANCE, spanning: float = C.SPANNING) -> DataFrame:
    """Raw blocks to blocks in reading order, over a whole corpus."""
    return split_runs(reading_order(zones(keep_blocks(raw), spanning), col_tolerance, block_tolerance))


def raw_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, raw_text): text blocks in order, joined by line breaks."""
    told = blocks.where("kind = 'text' and text <> ''")
    return told.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("raw_text"))
