"""Files as a stream: new ones of a folder are decoded and written batch by batch; a checkpoint remembers the old."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrine.plans.engine import Engine
from papyrine.sources import sinks

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest(engine: Engine, path: str, output: str, checkpoint: str, pattern: str = "*.{pdf,PDF}", once: bool = False, status_path: str | None = None) -> StreamingQuery:
    """Start the stream. Documents do not depend on each other, so no state is kept; a batch that is run again rewrites
    the same documents: its number names their folder. What a batch run would write, it writes."""
    files = engine.spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "content")

    def batch(rows: DataFrame, number: int) -> None:
        told = engine.write(rows, output, number)
        if status_path:
            sinks.write_status(told, status_path, number)
        engine.clear()

    writer = named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
