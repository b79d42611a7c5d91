"""Page sources: stored raw blocks, or files decoded by a plug-in that runs in the tasks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators.layout import RAW

BLOCKS = "array<struct<page_no:int,seq:int,page_w:double,page_h:double,type:int,x0:double,y0:double,x1:double,y1:double,lines:array<struct<x0:double,y0:double,x1:double,y1:double,spans:array<struct<text:string,size:double,x0:double,x1:double,flags:int,font:string>>>>>>"
Decoder = Callable[[bytes], tuple[Iterable[dict], str]]


def read_raw_blocks(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Raw blocks stored as Parquet or JSON."""
    return spark.read.schema(RAW).format(form).load(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """(path, name, length, content) of the files in a folder, not below it; `content` is only read where it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "length", "content")


def decode_files(files: DataFrame, decoder: Decoder, key: str = "name") -> DataFrame:
    """(key, blocks, full_text, error, seconds) a file. The decoder gets the bytes and gives raw block dicts and the full text.

    One file at a time is held. An exception ends up in `error` and leaves the other files alone; what the decoder had
    yielded by then is kept.
    """

    def one(content: bytes | None) -> tuple:
        blocks: list[dict] = []
        began, text, error = time.perf_counter(), None, None
        try:
            found, text = decoder(content or b"")
            for b in found:
                blocks.append(b)
        except Exception as e:  # a broken file is a row with an error, not a failed batch
            error = f"{type(e).__name__}: {e}"
        return json.dumps(blocks), text, error, time.perf_counter() - began

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                done = one(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([v], t) for v, t in zip(done, (pa.string(), pa.string(), pa.string(), pa.float64())))], names=["key", "blocks", "full_text", "error", "seconds"])

    decoded = files.select(F.col(key).cast("string").alias("key"), "content").mapInArrow(run, "key string, blocks string, full_text string, error string, seconds double")
    return decoded.select(F.col("key").alias(key), F.from_json("blocks", BLOCKS).alias("blocks"), "full_text", "error", "seconds")


def blocks_of(decoded: DataFrame, key: str = "name") -> DataFrame:
    """Raw blocks as rows, doc_id being the key."""
    return decoded.select(F.col(key).alias("doc_id"), F.inline("blocks"))
