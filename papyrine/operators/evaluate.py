"""Precision, recall and F1 of predictions against a gold set, in one pass over the joined rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import constants as C
from papyrine.functions.text import decompose_all, f1, normalize, ratio, ratio_match, scalar_match, surname

SCALARS = {"title": "fuzzy", "doi": "exact", "year": "exact", "journal": "fuzzy", "abstract": "ratio"}
SETS = {"authors": "surname", "keywords": "text", "sections": "text"}
COUNTS = ("figures", "tables", "equations")
FIELDS = ("title", "doi", "year", "journal", "abstract", "authors", "keywords", "sections", "figures", "tables", "equations")


def pair(gold: DataFrame, predicted: DataFrame, key: str = "stem") -> DataFrame:
    """Gold rows with a prediction of the same key: p_* and g_* columns; golds without one are not scored."""
    g = gold.select(key, *[F.col(c).alias(f"g_{c}") for c in gold.columns if c != key])
    return g.join(predicted.select(key, *[F.col(c).alias(f"p_{c}") for c in predicted.columns if c != key]), key)


def unmatched(gold: DataFrame, predicted: DataFrame, key: str = "stem") -> DataFrame:
    return gold.join(predicted, key, "left_anti").select(key)


def normalized_set(values: Column, normalizer: str, native: bool) -> Column:
    """Distinct normalised values without empty ones; normalizer 'text' or 'surname'."""
    listed = F.coalesce(values, F.array().cast("array<string>"))
    listed = listed if native else decompose_all(listed)
    one = (lambda v: surname(v, True)) if normalizer == "surname" else (lambda v: normalize(v, True))
    return F.array_distinct(F.filter(F.transform(listed, one), lambda v: v != ""))


def set_scores(predicted: Column, gold: Column) -> Column:
    """Struct (p, r, f) of two sets: all 1 if both are empty, all 0 if one is."""
    common = F.size(F.array_intersect(predicted, gold))
    p, r = F.when(F.size(predicted) > 0, common / F.size(predicted)).otherwise(F.lit(0.0)), F.when(F.size(gold) > 0, common / F.size(gold)).otherwise(F.lit(0.0))
    empty = (F.size(predicted) == 0) & (F.size(gold) == 0)
    one = lambda x: F.when(empty, F.lit(1.0)).otherwise(x)
    return F.struct(one(p).alias("p"), one(r).alias("r"), one(f1(p, r)).alias("f"))


def count_scores(predicted: Column, gold: Column) -> Column:
    p0 = F.coalesce(predicted, F.lit(0))
    hit = F.least(p0, gold)
    p, r = F.when(p0 > 0, hit / p0).otherwise(F.lit(0.0)), hit / gold
    return F.struct(p.alias("p"), r.alias("r"), f1(p, r).alias("f"))


def scalar_aggregates(name: str, mode: str, native: bool) -> list[Column]:
    """Counts of the predicted, the gold and the matching values of a scalar field; 0 is a value, '' is none."""
    p, g = (normalize(F.col(f"{x}_{name}"), native) for x in "pg")
    filled = lambda x: F.coalesce(F.col(f"{x}_{name}").cast("string"), F.lit("")) != ""
    match = ratio_match(p, g) if mode == "ratio" else scalar_match(p, g, mode == "fuzzy")
    return [F.count_if(filled("p")).alias("predicted"), F.count_if(filled("g")).alias("support"), F.count_if(filled("p") & match).alias("correct")]


def report(pairs: DataFrame, native: bool = False, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, precision, recall, f1, support): scalars micro-averaged, sets and counts as means over golds that have any.

    One aggregate over the pairs; core fields always, others if they have support. Fields that neither side has are left
    out.
    """
    have = {c[2:] for c in pairs.columns if c[:2] in ("p_", "g_")}
    names, aggregates = [], []
    for k in (f for f in fields if f in have):
        names.append(k)
        if k in SCALARS:
            n = scalar_aggregates(k, SCALARS[k], native)
            aggregates.append(F.struct(*n).alias(k))
            continue
        if k in SETS:
            gold = F.col(f"g_{k}")
            counted = F.coalesce(F.size(gold), F.lit(0)) > 0
            s = F.when(counted, set_scores(normalized_set(F.col(f"p_{k}"), SETS[k], native), normalized_set(gold, SETS[k], native)))
        else:
            counted = F.coalesce(F.col(f"g_{k}"), F.lit(0)) > 0
            s = F.when(counted, count_scores(F.col(f"p_{k}"), F.col(f"g_{k}")))
        zero = F.lit(0.0)
        aggregates.append(F.struct(F.coalesce(F.avg(s["p"]), zero).alias("p"), F.coalesce(F.avg(s["r"]), zero).alias("r"), F.coalesce(F.avg(s["f"]), zero).alias("f"), F.count_if(counted).alias("support")).alias(k))
    one = pairs.agg(*aggregates)
    rows = []
    for k in names:
        if k in SCALARS:
            p, r = ratio(F.col(f"{k}.correct"), F.col(f"{k}.predicted")), ratio(F.col(f"{k}.correct"), F.col(f"{k}.support"))
            rows.append(F.struct(F.lit(k).alias("field"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), F.col(f"{k}.support").alias("support")))
        else:
            rows.append(F.struct(F.lit(k).alias("field"), F.col(f"{k}.p").alias("precision"), F.col(f"{k}.r").alias("recall"), F.col(f"{k}.f").alias("f1"), F.col(f"{k}.support").alias("support")))
    listed = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return listed.where(F.col("field").isin(*C.CORE_FIELDS) | (F.col("support") > 0))


def pair_by_position(gold: DataFrame, predicted: DataFrame, position: str = "pos") -> DataFrame:
    """Gold and predicted rows of equal position as pairs; the query fails where one side has a row more."""
    g = gold.select(position, *[F.col(c).alias(f"g_{c}") for c in gold.columns if c != position], F.lit(True).alias("_g"))
    p = predicted.select(position, *[F.col(c).alias(f"p_{c}") for c in predicted.columns if c != position], F.lit(True).alias("_p"))
    both = g.join(p, position, "full_outer")
    uneven = F.col("_g").isNull() | F.col("_p").isNull()
    checked = F.when(uneven, F.raise_error(F.lit("predictions and golds differ in number"))).otherwise(F.col(position).cast("string"))
    return both.withColumn("_checked", checked).where("_checked is not null").drop("_g", "_p", "_checked")


def _headings(nodes: list[dict]) -> list[str]:
    out: list[str] = []
    stack = list(reversed(nodes))
    while stack:
        node = stack.pop()
        if node.get("heading"):
            out.append(node["heading"])
        stack += reversed(node.get("subsections") or [])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def flat_headings(trees: pd.Series) -> pd.Series:
    """Headings of a section tree in JSON, in pre-order, empty ones left out."""
    return trees.map(lambda t: _headings(json.loads(t)) if t else [])


def predictions(documents: DataFrame, key: str = "stem") -> DataFrame:
    """Written documents (see sources.gold.read_documents) as the flat rows that are scored."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    meta = [F.col(f"metadata.{c}").alias(c) for c in ("title", "authors", "doi", "year", "journal", "abstract", "keywords")]
    return documents.select(key, *meta, flat_headings("sections").alias("sections"), *[size(c).alias(c) for c in COUNTS])
