"""What became of each document, and of the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("title", "authors", "abstract", "doi", "sections", "raw_text")
NO_BLOCKS = "no blocks extracted"


def pending(docs: DataFrame, outputs: DataFrame, key: str = "doc_id", overwrite: bool = False) -> DataFrame:
    """Documents without an output yet; all of them where outputs are overwritten."""
    return docs if overwrite else docs.join(outputs.select(key).distinct(), key, "left_anti")


def skipped(docs: DataFrame, outputs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(outputs.select(key).distinct(), key, "left_semi")


def missing_fields(kinds: dict[str, str]) -> Column:
    """Ordered array of required fields without a value; kinds: field to 'text' or 'list'."""
    def lacks(name: str) -> Column:
        return F.coalesce(F.size(name), F.lit(0)) <= 0 if kinds[name] == "list" else F.trim(F.coalesce(F.col(name), F.lit(""))) == ""

    return F.array_compact(F.array(*[F.when(lacks(k), F.lit(k)) for k in REQUIRED if k in kinds]))


def status_of(error: Column, was_skipped: Column, missing: Column) -> Column:
    return F.when(was_skipped, "skipped").when(error.isNotNull(), "error").when(F.size(missing) > 0, "partial").otherwise("success")


def summarize(statuses: DataFrame, total_seconds: float | None = None) -> DataFrame:
    """One row: counts by status, total seconds, and mean seconds of the documents that were worked on."""
    count = lambda s: F.count_if(F.col("status") == s)
    total = F.coalesce(F.sum("seconds"), F.lit(0.0)) if total_seconds is None else F.lit(float(total_seconds))
    worked = F.when(F.col("status") != "skipped", F.col("seconds"))
    return statuses.agg(F.count(F.lit(1)).alias("total"), count("success").alias("success"), count("partial").alias("partial"), count("error").alias("errors"), count("skipped").alias("skipped"), total.alias("total_seconds"), F.coalesce(F.avg(worked), F.lit(0.0)).alias("avg_seconds"))
