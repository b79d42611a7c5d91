"""Words of an OCR engine to blocks, and when they are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions import constants as C
from papyrine.functions.text import clean_text, strip


def ocr_lines(words: DataFrame, dpi: int = C.OCR_DPI) -> DataFrame:
    """Blocks from words (doc_id, page_no, block, par, line, left, top, width, height, conf, text).

    Blank words and words of negative or unreadable confidence go, then lines of one character. Coordinates turn from
    pixels into points; the font is the line's height in points.
    """
    scale = 72.0 / dpi
    sure = F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)) >= 0
    told = words.withColumn("_t", strip(F.coalesce("text", F.lit("")))).where((F.col("_t") != "") & sure)
    lines = told.groupBy("doc_id", "page_no", "block", "par", "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "_t"))), lambda x: x["_t"]), " ").alias("text"),
        F.min("left").alias("l"), F.min("top").alias("t"), F.max(F.col("left") + F.col("width")).alias("r"), F.max(F.col("top") + F.col("height")).alias("b"),
        F.max("height").alias("h"),
    )
    return lines.where(F.length("text") > 1).select(
        "doc_id", "page_no", "block", "par", "line", clean_text("text").alias("text"),
        F.when(F.col("h") > 0, F.bround(F.col("h") * scale, 1)).alias("font"),
        *[(F.col(c) * scale).alias(n) for c, n in (("l", "left"), ("t", "top"), ("r", "right"), ("b", "bottom"))],
    )


def need_ocr(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of `docs` without a single text block."""
    return docs.join(blocks.where("kind = 'text' and text <> ''").select("doc_id").distinct(), "doc_id", "left_anti")


def pages_needing_ocr(pages: DataFrame) -> DataFrame:
    """Of pages (doc_id, page_no, page_text) those without any text, as scans are."""
    return pages.where(strip(F.coalesce("page_text", F.lit(""))) == "").select("doc_id", "page_no")


def add_ocr(blocks: DataFrame, ocr_blocks: DataFrame) -> DataFrame:
    """Blocks of the extractor, then those of OCR, positions counted on."""
    last = blocks.groupBy("doc_id").agg(F.max("pos").alias("_last"))
    moved = ocr_blocks.join(last, "doc_id", "left").withColumn("pos", F.col("pos") + F.coalesce("_last", F.lit(0))).drop("_last")
    return blocks.unionByName(moved, allowMissingColumns=True)
