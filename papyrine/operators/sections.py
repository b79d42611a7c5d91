"""Section trees as flat tables: headings by ordered rules, levels by a fold, parents and contents by position.

Blocks are rows (doc_id, pos, text, font, bold, kind). The heading state that the rules need is one flag for references
and one for the title, both window functions; the level of an un-numbered heading depends on the one before only.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import constants as C
from papyrine.functions.text import let, starts_with_any, strip

# Patterns of numbered headings, quantities, what may follow references, and captions.
NUMBERED = r"(?i)^((?:Section\s+)?S\d+|(?:\d+\.)+\d*|\d+\.?|[IVX]+\.)[\s\-]+(.+)"
UNITS = r"(?i)^[\d\s.,\-]+(?:mM|cm|mm|mV|mA|h|min|s|kΩ|µm)?$"
IN_REFERENCES = r"^(appendix|supplementary|section\s+s|s\d+)"
CAPTION_START = r"^(figure|fig\.|table|scheme)\s*\d+"


def base_font(blocks: DataFrame) -> DataFrame:
    """(doc_id, base_font): the most frequent font of text blocks, the first seen on ties; 12 without any."""
    fonts = blocks.where("kind = 'text'").groupBy("doc_id", "font").agg(F.count("font").alias("n"), F.min(F.when(F.col("font").isNotNull(), F.col("pos"))).alias("first"))
    best = fonts.groupBy("doc_id").agg(F.max_by("font", F.struct(F.col("n"), -F.col("first"))).alias("_f"))
    return best.select("doc_id", F.coalesce("_f", F.lit(C.DEFAULT_FONT)).alias("base_font"))


def chunks(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, part, text, font, bold): blocks whose first line is a standard heading in two; skipped ones left out."""
    told = blocks.where("kind = 'text'").withColumn("_t", strip(F.coalesce("text", F.lit("")))).where("_t <> ''")
    first, rest = strip(F.split_part("_t", F.lit("\n"), F.lit(1))), strip(F.substring(F.col("_t"), F.locate("\n", F.col("_t")) + 1, F.length("_t")))
    glued = F.contains("_t", F.lit("\n")) & F.lower(first).isin(*C.ONTOLOGY)
    both = F.when(glued, F.array(F.struct(first.alias("text"), F.col("bold").alias("bold")), F.struct(rest.alias("text"), F.lit(False).alias("bold")))).otherwise(F.array(F.struct(F.col("_t").alias("text"), F.col("bold").alias("bold"))))
    parts = told.select("doc_id", "pos", "font", F.posexplode(both).alias("part", "c")).select("doc_id", "pos", "part", F.col("c.text").alias("text"), "font", F.col("c.bold").alias("bold"))
    return parts.where(~starts_with_any(F.lower("text"), C.SKIP_STARTS))


def numbered_level(text: Column) -> Column:
    """Struct (verdict, level, number) of the numbering rule: 'yes', 'no', or 'pass' where later rules decide."""
    number = F.regexp_extract(text, NUMBERED, 1)
    rest = F.regexp_extract(text, NUMBERED, 2)
    bare = F.replace(F.replace(F.regexp_replace(number, r"^[ .]+|[ .]+$", ""), F.lit("Section "), F.lit("")), F.lit("section "), F.lit(""))
    fits = (number != "") & (F.length(text) < 150) & ~F.contains(text, F.lit("\n")) & (F.length(rest) > 2) & rest.rlike(r"\p{L}")
    rejected = F.endswith(text, F.lit(".")) | rest.rlike(r"^\p{Ll}") | (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) >= 2)
    initials = rest.rlike(r"^[A-Z]\.\s+[A-Z]")
    verdict = F.when(fits & rejected, "no").when(fits & ~initials, "yes").otherwise("pass")
    return F.struct(verdict.alias("verdict"), (F.size(F.split(bare, r"\.")) + 1).alias("level"), bare.alias("number"))


def classify(parts: DataFrame) -> DataFrame:
    """Adds to chunks with base_font and font filled: `plain`, the class without regard to the references flag.

    Classes: 'no', 'ontology', 'numbered', 'title' (large font; the first of these only is one), 'bold'.
    """
    text, low = F.col("text"), F.lower("text")
    n = numbered_level(text)
    start = F.regexp_replace(text, "^[^a-zA-Z]+", "")
    bold = (
        F.col("bold") & (F.col("font") >= F.col("base_font") - 0.5) & ~F.endswith(text, F.lit(".")) & (F.length(text) < 100) & ~F.contains(text, F.lit("\n"))
        & ~start.rlike("^[a-z]") & (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) < 2) & ~F.contains(text, F.lit(";"))
        & (F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")) > 1) & ~F.startswith(low, F.lit("abstract:"))
    )
    large = F.col("font") > F.col("base_font") + 2.5
    plain = (
        F.when(low.rlike(CAPTION_START), "no").when(low.isin(*C.ONTOLOGY), "ontology").when((F.length(text) < 4) | (F.length(text) > 300), "no")
        .when(text.rlike(UNITS), "no").when(F.col("_n.verdict") == "no", "no").when(F.col("_n.verdict") == "yes", "numbered")
        .when(large, "title").when(bold, "bold").otherwise("no")
    )
    return parts.withColumn("_n", n).withColumn("plain", plain)


def headings(blocks: DataFrame) -> DataFrame:
    """Chunks with rn (their order), base_font, is_heading, level0 (before the fold) and number."""
    parts = chunks(blocks).join(base_font(blocks), "doc_id")
    filled = parts.withColumn("font", F.coalesce(F.nullif("font", F.lit(0.0)), "base_font"))
    order = Window.partitionBy("doc_id").orderBy("pos", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = classify(filled).withColumn("rn", F.row_number().over(order))
    # The flag rises at a heading "references"; it is one wherever it first occurs, since it stands in the ontology.
    locked = seen.withColumn("in_refs", F.coalesce(F.max((F.lower("text") == "references").cast("int")).over(before), F.lit(0)) == 1)
    open_ = locked.withColumn("class", F.when(F.col("in_refs") & ~F.lower("text").rlike(IN_REFERENCES), "no").otherwise(F.col("plain")))
    titled = open_.withColumn("_titles", F.sum((F.col("class") == "title").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    heading = F.col("class").isin("ontology", "numbered", "bold") | ((F.col("class") == "title") & (F.col("_titles") == 1))
    level = F.when(F.col("class") == "title", 1).when(F.col("class") == "numbered", F.col("_n.level")).otherwise(2)
    return titled.select(
        "doc_id", "pos", "part", "rn", "text", "font", "bold", "base_font", "in_refs", "class", heading.alias("is_heading"),
        F.when(heading, level).alias("level0"), F.when(heading & (F.col("class") == "numbered"), F.col("_n.number")).alias("number"),
    )


LEVELS = "array<struct<rn:int,level:int>>"
PARENTS = "array<struct<rn:int,level:int,parent_rn:int>>"


def level_array(heads: Column) -> Column:
    """Array of (rn, level) from headings (rn, font, level0, number) in order.

    An un-numbered heading below level 1 goes one deeper than the heading before if its font is over half a point
    smaller, one up (to 2 at most) if larger, and takes its level otherwise.
    """
    none = F.struct(F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("font"), F.array().cast(LEVELS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        moved = F.when(x["font"] < s["font"] - 0.5, s["level"] + 1).when(x["font"] > s["font"] + 0.5, F.greatest(F.lit(2), s["level"] - 1)).otherwise(s["level"])
        level = F.when(x["number"].isNull() & s["level"].isNotNull() & (x["level0"] >= 2), moved).otherwise(x["level0"])
        return F.struct(level.alias("level"), x["font"].alias("font"), F.concat(s["out"], F.array(F.struct(x["rn"].alias("rn"), level.alias("level")))).alias("out"))

    return F.aggregate(heads, none, step, lambda s: s["out"])


def parent_array(levels: Column) -> Column:
    """Array of (rn, level, parent_rn): the nearest heading before with a smaller level, kept on a stack."""
    none = F.struct(F.array().cast(LEVELS).alias("stack"), F.array().cast(PARENTS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        kept = F.filter(s["stack"], lambda h: h["level"] < x["level"])
        own = F.struct(x["rn"].alias("rn"), x["level"].alias("level"), F.get(kept, F.size(kept) - 1)["rn"].alias("parent_rn"))
        return F.struct(F.concat(kept, F.array(F.struct(x["rn"].alias("rn"), x["level"].alias("level")))).alias("stack"), F.concat(s["out"], F.array(own)).alias("out"))

    return F.aggregate(levels, none, step, lambda s: s["out"])


def fold_levels(found: DataFrame) -> DataFrame:
    """(doc_id, rn, level) of headings."""
    per_doc = found.where("is_heading").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rn", "font", "level0", "number"))).alias("_h"))
    return per_doc.select("doc_id", F.inline(level_array(F.col("_h"))))


def parents(levels: DataFrame) -> DataFrame:
    """(doc_id, rn, level, parent_rn) of headings with levels."""
    per_doc = levels.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rn", "level"))).alias("_h"))
    return per_doc.select("doc_id", F.inline(parent_array(F.col("_h"))))


def section_table(blocks: DataFrame) -> DataFrame:
    """Sections (doc_id, rn, parent_rn, level, number, heading, content): rn is pre-order; text before the first heading goes.

    A document's chunks are gathered once, where the windows have put them, and folded in place: no join follows.
    """
    chunk = F.struct("rn", "is_heading", "text", "font", "level0", "number")
    per_doc = headings(blocks).groupBy("doc_id").agg(F.sort_array(F.collect_list(chunk)).alias("_c"))

    def rows(c: Column) -> Column:
        tree = parent_array(level_array(F.filter(c, lambda x: x["is_heading"])))

        def section(p: Column, k: Column, every: Column) -> Column:
            own = F.get(c, p["rn"] - 1)  # rn counts chunks from 1
            end = F.coalesce(F.get(every, k + 1)["rn"], F.size(c) + 1)
            content = F.array_join(F.transform(F.slice(c, p["rn"] + 1, end - p["rn"] - 1), lambda x: x["text"]), "\n\n")
            return F.struct(p["rn"].alias("rn"), p["parent_rn"].alias("parent_rn"), p["level"].alias("level"), own["number"].alias("number"), own["text"].alias("heading"), content.alias("content"))

        return let(tree, lambda every: F.transform(every, lambda p, k: section(p, k, every)))

    return per_doc.select("doc_id", F.inline(let(F.col("_c"), rows)))


def acknowledgments(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections without it, (doc_id, acknowledgments)): the first section of thanks in pre-order, with its subtree.

    An empty one is removed as well. At the top it ends the search; below, the search skips the rest of its siblings
    and goes on behind their parent.
    """
    marks = F.lower(strip("heading")).isin(*C.ACKNOWLEDGMENTS)
    text = F.nullif(strip("content"), F.lit(""))
    item = F.struct("rn", "level", F.coalesce("parent_rn", F.lit(0)).alias("parent"), marks.alias("hit"), text.alias("text"))
    per_doc = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("_s"))
    none = F.struct(F.lit(False).alias("done"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("cut"), F.array().cast("array<int>").alias("closed"), F.array().cast("array<int>").alias("gone"))

    def step(s: Column, x: Column) -> Column:
        """cut: level of the removed section whose subtree is passing; closed: parents whose children are not looked at any more."""
        below = s["cut"].isNotNull() & (x["level"] > s["cut"])
        skipped = F.array_contains(s["closed"], x["parent"])
        taken = ~below & ~s["done"] & ~skipped & x["hit"]
        ends = x["text"].isNotNull() | (x["parent"] == 0)
        return F.struct(
            (s["done"] | (taken & ends)).alias("done"),
            F.when(taken, x["text"]).otherwise(s["text"]).alias("text"),
            F.when(below, s["cut"]).when(taken, x["level"]).alias("cut"),
            F.when(taken & ~ends, F.concat(s["closed"], F.array(x["parent"]))).when(skipped, F.concat(s["closed"], F.array(x["rn"]))).otherwise(s["closed"]).alias("closed"),
            F.when(below | taken, F.concat(s["gone"], F.array(x["rn"]))).otherwise(s["gone"]).alias("gone"),
        )

    folded = per_doc.select("doc_id", F.aggregate("_s", none, step, lambda s: F.struct(F.when(s["done"], s["text"]).alias("text"), s["gone"].alias("gone"))).alias("_f"))
    removed = folded.select("doc_id", F.explode("_f.gone").alias("rn"))
    return sections.join(removed, ["doc_id", "rn"], "left_anti"), folded.select("doc_id", F.col("_f.text").alias("acknowledgments"))


def outline(sections: DataFrame) -> DataFrame:
    """Headings in pre-order, empty ones left out."""
    return sections.where("heading <> ''").select("doc_id", "rn", "level", "heading")


def _nested(rows: list[dict]) -> str:
    nodes, roots = {}, []
    for r in rows:
        node = {"heading": r["heading"], "level": r["level"], "content": r["content"], "subsections": [], "number": r["number"], "status": None, "status_effective_from": None}
        nodes[r["rn"]] = node
        (nodes[r["parent_rn"]]["subsections"] if r["parent_rn"] in nodes else roots).append(node)
    return json.dumps(roots, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _nest(docs: pd.Series) -> pd.Series:
    return docs.map(lambda s: _nested(json.loads(s)))


def nested_json(sections: DataFrame) -> DataFrame:
    """(doc_id, sections): the tree as JSON, children inside their parents, built from flat rows by a stack."""
    rows = F.sort_array(F.collect_list(F.struct("rn", "parent_rn", "level", "number", "heading", "content")))
    listed = sections.groupBy("doc_id").agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("_rows"))
    return listed.select("doc_id", _nest("_rows").alias("sections"))


