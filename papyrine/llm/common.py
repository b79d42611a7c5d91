"""What the corpus operators share: input tables, the shared folder, bounded samples, literals, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where it is unset in local mode one of our own."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="papyrine-shared-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows for the plans that run inside: for rows that hold much."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return what this Python worker has freed to the system; idle workers would hold it beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def sample_docs(docs: DataFrame, rows: int, id_col: str = "doc_id", limit: bool = True) -> DataFrame:
    """About `rows` documents, at most twice as many where `limit` is set, chosen by the hash of their id.

    Only for fitting models or caches on a bounded sample; results never depend on rows being left out.
    """
    total = docs.select(id_col).count()
    step = max(1, total // max(1, rows))
    chosen = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(step)) == 0) if step > 1 else docs
    return chosen.limit(2 * rows) if limit else chosen


def literal_of(df: DataFrame) -> Column:
    """The single value of a one-row, one-column DataFrame as a literal column, in Spark's compact binary form."""
    jvm = df.sparkSession._jvm
    plan = df._jdf.queryExecution().executedPlan()
    row = plan.executeCollect()[0]
    kind = plan.schema().fields()[0].dataType()
    value = row.get(0, kind)
    expression = jvm.org.apache.spark.sql.catalyst.expressions.Literal(value, kind)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); component is the smallest node reachable.

    Minimum labels travel over the edges and labels jump to their label's label, so rounds grow with the logarithm
    of the diameter. Every round is written to the shared folder; nothing is collected but whether a label changed.
    Self-loops give their node a row; null ends are ignored.
    """
    sym = materialize(
        edges.where("a is not null and b is not null").select("a", "b").union(edges.where("a is not null and b is not null").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = kept = materialize(sym.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        heard = sym.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        lower = materialize(labels.join(heard, "node", "left").select("node", F.col("component").alias("before"), F.least("component", F.coalesce("heard", "component")).alias("component")), "labels")
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = materialize(lower.join(up, "component", "left").select("node", "before", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")
        settled = jumped.where("component <> before").isEmpty()
        discard(kept, lower)
        kept, labels = jumped, jumped.select("node", "component")
        if settled:
            discard(sym)
            return labels
