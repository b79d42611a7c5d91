"""Written results: documents as JSON in batches, reports, status rows."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = "@sections@"  # stands for the tree, which is JSON text already


def boxed(item: Column) -> Column:
    return F.struct(*[item[k].alias(k) for k in ("left", "top", "right", "bottom")])


def document_struct(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, metadata, sections, figures, tables, equations, acknowledgments, raw_text): the shape of a written document.

    Columns of the flat form that are lacking count as null, lists of items as empty.
    """
    have = set(documents.columns)
    text = lambda c, kind="string": (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    listed = lambda c: F.coalesce(F.col(c) if c in have else F.lit(None), F.array().cast("array<string>")).alias(c)
    meta = F.struct(
        F.coalesce(text("title"), F.lit("")).alias("title"), text("title_en"), listed("authors"), text("abstract"), listed("keywords"), text("doi"), text("journal"), text("year", "int"),
        text("metadata_source"), text("metadata_confidence", "double"), text("normative"),
    )
    panel = lambda x: F.array(F.struct(x["file"].alias("img_path"), boxed(x).alias("bbox")))
    head = lambda x: [x["id"].alias("id"), x["caption"].alias("caption"), x["page_no"].cast("int").alias("page"), boxed(x).alias("bbox"), x["file"].alias("img_path")]
    cells = lambda x: F.coalesce(x["data"], F.array().cast("array<array<string>>")).alias("data")
    box = "bbox:struct<left:double,top:double,right:double,bottom:double>"
    forms = {
        "figures": (lambda x: F.struct(*head(x), panel(x).alias("panels")), f"array<struct<id:string,caption:string,page:int,{box},img_path:string,panels:array<struct<img_path:string,{box}>>>>"),
        "tables": (lambda x: F.struct(*head(x), cells(x)), f"array<struct<id:string,caption:string,page:int,{box},img_path:string,data:array<array<string>>>>"),
        "equations": (lambda x: F.struct(x["id"].alias("id"), x["latex"].alias("latex"), x["context"].alias("context"), x["page_no"].cast("int").alias("page"), boxed(x).alias("bbox")), f"array<struct<id:string,latex:string,context:string,page:int,{box}>>"),
    }
    items = [(F.coalesce(F.transform(c, form).cast(kind), F.array().cast(kind)) if c in have else F.array().cast(kind)).alias(c) for c, (form, kind) in forms.items()]
    tree = F.coalesce(F.col("sections"), F.lit("[]")) if "sections" in have else F.lit("[]")
    return documents.select(key, meta.alias("metadata"), tree.alias("sections"), *items, text("acknowledgments"), F.coalesce(text("raw_text"), F.lit("")).alias("raw_text"))


def document_json(documents: DataFrame, key: str = "doc_id", pretty: bool = True, stem: bool = False) -> DataFrame:
    """(key, json): every other column in one object, nulls kept; a column `sections` holding JSON text is set in as it is."""
    others = [c for c in documents.columns if c != key]
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})
    fields = [*([F.col(key).cast("string").alias("stem")] if stem else []), *[F.col(c) for c in others if c != "sections"]]
    if "sections" not in others:
        return documents.select(key, F.to_json(F.struct(*fields), options).alias("json"))
    # The mark is the object's last field, so its place is known whatever the texts hold.
    text = F.to_json(F.struct(*fields, F.lit(SECTIONS).alias("sections")), options)
    tail = f'"{SECTIONS}"' + ("\n}" if pretty else "}")
    body = F.expr(f"left(_t, length(_t) - {len(tail)})")
    return documents.select(key, "sections", text.alias("_t")).select(key, F.concat(body, F.coalesce("sections", F.lit("[]")), F.lit(tail.removeprefix(f'"{SECTIONS}"'))).alias("json"))


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as libraries other than Spark want it."""
    system, where = file_system(spark, path)
    return system.makeQualified(where).toString().replace("file:/", "file:///", 1) if "://" not in path else path


def exists(spark: SparkSession, path: str) -> bool:
    system, where = file_system(spark, path)
    return system.exists(where)


def next_batch(spark: SparkSession, path: str) -> int:
    """One more than the last batch under `path`."""
    system, where = file_system(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return 1 + max((int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")), default=-1)


def write_documents(documents: DataFrame, path: str, key: str = "doc_id", batch: int | None = None) -> None:
    """The documents as JSON lines, many to a file, in a batch folder of their own; a batch written again replaces itself.

    Later batches stand above earlier ones where a key is in both.
    """
    batch = next_batch(documents.sparkSession, path) if batch is None else batch
    rows = document_json(document_struct(documents, key), key, pretty=False, stem=True)
    rows.select(F.col("json").alias("value")).write.mode("overwrite").text(f"{path}/batch={batch}")


def write_images(images: DataFrame, path: str) -> DataFrame:
    """Write rows (doc_id, file, content) as files under path/doc_id; returns (doc_id, file, bytes). Each is written whole
    under a draft name first, so a retried task leaves no half of one."""

    def run(batches):
        system, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for doc, name, content in zip(*(c.to_pylist() for c in batch.columns)):
                folder = f"{base}/{doc}"
                system.create_dir(folder, recursive=True)
                draft = f"{folder}/{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(draft) as out:
                    out.write(content or b"")
                system.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pc.binary_length(batch.column(2)).cast(pa.int64())], names=["doc_id", "file", "bytes"])

    return images.select(F.col("doc_id").cast("string"), "file", F.col("content").cast("binary")).mapInArrow(run, "doc_id string, file string, bytes long")


def write_report(report: DataFrame, path: str) -> None:
    """A report with three decimals, as JSON lines."""
    report.select("field", *[F.bround(c, 3).alias(c) for c in ("precision", "recall", "f1")], "support").coalesce(1).write.mode("overwrite").json(path)


def write_status(statuses: DataFrame, path: str, batch: int) -> None:
    """The status rows of a batch; written again they replace themselves."""
    statuses.write.mode("overwrite").parquet(f"{path}/batch={batch}")
