"""Gold sets and written documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<title:string,authors:array<string>,doi:string,year:int,journal:string,abstract:string,keywords:array<string>,sections:array<string>,figures:int,tables:int,equations:int>"
BOX = "bbox:struct<left:double,top:double,right:double,bottom:double>"
DOCUMENT = (
    "metadata struct<title:string,title_en:string,authors:array<string>,abstract:string,keywords:array<string>,doi:string,journal:string,year:int,metadata_source:string,metadata_confidence:double,normative:string>,"
    f"sections string,figures array<struct<id:string,caption:string,page:int,{BOX},img_path:string,panels:array<struct<img_path:string,{BOX}>>>>,"
    f"tables array<struct<id:string,caption:string,page:int,{BOX},img_path:string,data:array<array<string>>>>,"
    f"equations array<struct<id:string,latex:string,context:string,page:int,{BOX}>>,acknowledgments string,raw_text string"
)


def parse_gold(texts: DataFrame) -> DataFrame:
    """Rows (stem, fields) of JSON objects keyed by file name, in column `value`; the stem is the name without its suffix."""
    entries = texts.select(F.explode(F.from_json("value", f"map<string,{ENTRY}>")).alias("name", "e"))
    return entries.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "e.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return parse_gold(spark.read.text(path, wholetext=True))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of sinks.write_documents with their stems, the last written of each; `sections` stays JSON text, being
    recursive."""
    rows = spark.read.schema("value string, batch long").text(path).select("batch", F.from_json("value", f"stem string, {DOCUMENT}").alias("d"))
    last = rows.groupBy("d.stem").agg(F.max_by("d", "batch").alias("d"))
    return last.select("d.*")


def read_stems(spark: SparkSession, path: str) -> DataFrame:
    """The stems of written documents, without their contents."""
    return spark.read.schema("value string, batch long").text(path).select(F.get_json_object("value", "$.stem").alias("stem")).distinct()


def read_document_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents stored one a file, named after their stems."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("stem"), F.from_json("value", DOCUMENT).alias("d"))
    return rows.select("stem", "d.*")
