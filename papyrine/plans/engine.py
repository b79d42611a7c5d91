"""The whole plan of a batch: blocks, metadata, sections, visuals, documents, status and summary.

Plug-ins decode files, read text off images, detect layout and look records up; each is optional and the plan without
it has no trace of it. Everything between them is relational and keyed by doc_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import layout, metadata, ocr, sections, status, visuals
from papyrine.sources import gold, raw, sinks

Rows = Callable[[DataFrame], DataFrame]


@dataclass
class Engine:
    """spark, plug-ins from rows to rows, and options.

    decoder: bytes to (raw block dicts, full text). ocr: documents without text to OCR blocks in the engine's form.
    layout_detector: documents to detections. equation_detector: documents to detector boxes with raw_latex.
    crossref: (doi) to (doi, message). llm: (doc_id, page_text) to (doc_id, title, authors, abstract). vlm: tables (doc_id,
    file, page_no and box) to (doc_id, file, reply). renderer: visuals (the same columns) to (doc_id, file, content), which
    are written under `images`, by default a folder beside a run's output. staging: a folder for intermediate tables that all executors share; the
    blocks, which many operators read, are stored there instead of being laid out anew for each.
    """

    spark: SparkSession
    as_of_year: int
    decoder: raw.Decoder | None = None
    ocr: Rows | None = None
    layout_detector: Rows | None = None
    equation_detector: Rows | None = None
    crossref: Rows | None = None
    llm: Rows | None = None
    vlm: Rows | None = None
    renderer: Rows | None = None
    staging: str | None = None
    offline: bool = False
    extract_images: bool = True
    options: dict = field(default_factory=dict)
    images: str | None = None
    written: list = field(default_factory=list, init=False, repr=False)

    def blocks(self, raw_blocks: DataFrame, docs: DataFrame) -> DataFrame:
        """Blocks in reading order; documents without any text go to OCR where there is one."""
        found = layout.page_blocks(raw_blocks, **self.options)
        if self.ocr is None:
            return found
        return ocr.add_ocr(found, self.ocr(ocr.need_ocr(found, docs)))

    def metadata(self, blocks: DataFrame, texts: DataFrame) -> DataFrame:
        looked = None
        if self.crossref is not None and not self.offline:
            dois = texts.select(metadata.find_doi("full_text").alias("doi")).where("doi is not null").distinct()
            looked = metadata.parse_crossref(self.crossref(dois))
        return metadata.metadata(blocks, texts, self.as_of_year, crossref=looked, llm=self.llm, offline=self.offline)

    def stored(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows as a table of the staging folder, where there is one."""
        if self.staging is None:
            return rows
        path = f"{self.staging}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.written.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self) -> None:
        """Delete the intermediate tables of this engine."""
        for path in self.written:
            system, where = sinks.file_system(self.spark, path)
            system.delete(where, True)
        self.written.clear()

    def documents(self, raw_blocks: DataFrame, texts: DataFrame) -> DataFrame:
        """One row a document of `texts` (doc_id, full_text): metadata, sections as JSON, figures, tables, equations, status."""
        docs = texts.select("doc_id")
        blocks = self.stored(self.blocks(raw_blocks, docs), "blocks")
        table = sections.section_table(blocks)
        left, thanks = sections.acknowledgments(table)
        out = self.metadata(blocks, texts).join(sections.nested_json(left), "doc_id", "left").join(thanks, "doc_id", "left").join(layout.raw_text(blocks), "doc_id", "left")
        out = out.join(left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections")), "doc_id", "left")
        out = out.join(blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks")), "doc_id", "left")
        none = F.array()
        if self.extract_images and self.layout_detector is not None:
            found = visuals.detections(self.layout_detector(docs))
            replies = None if self.vlm is None else self.vlm(found.where("pool = 'table'").select("doc_id", "file", "page_no", "left", "top", "right", "bottom"))
            if self.renderer is not None and self.images is not None:
                self.stored(sinks.write_images(self.renderer(found.select("doc_id", "file", "page_no", "left", "top", "right", "bottom")), self.images), "images")
            items = visuals.read_tables(visuals.assign_captions(found, visuals.captions(blocks)), replies)
            for pool, name in (("figure", "figures"), ("table", "tables")):
                listed = items.where(F.col("pool") == pool).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "id", "caption", "page_no", "left", "top", "right", "bottom", "file", "data"))).alias(name))
                out = out.join(listed, "doc_id", "left").withColumn(name, F.coalesce(name, none.cast(listed.schema[name].dataType)))
        if self.equation_detector is not None:
            found = visuals.equations(visuals.crop_boxes(self.equation_detector(docs)))
            told = visuals.equation_context(found, blocks)
            listed = told.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("eq_no", "id", "latex", "context", "page_no", "left", "top", "right", "bottom"))).alias("equations"))
            out = out.join(listed, "doc_id", "left").withColumn("equations", F.coalesce("equations", none.cast(listed.schema["equations"].dataType)))
        return out

    def statuses(self, documents: DataFrame, texts: DataFrame) -> DataFrame:
        """(doc_id, status, missing, error, seconds) of all documents of `texts`, which may carry `error` and `seconds`.

        Without a block a document is an error; with blocks, such as images or what a broken file still gave, it is not.
        """
        kinds = {"title": "text", "authors": "list", "abstract": "text", "doi": "text", "raw_text": "text"}
        own = lambda c, kind: (F.col(c) if c in texts.columns else F.lit(None)).cast(kind).alias(c)
        told = texts.select("doc_id", own("error", "string"), own("seconds", "double")).join(documents.select("doc_id", *kinds, "n_sections", "n_blocks"), "doc_id", "left")
        lacking = F.array_compact(F.concat(status.missing_fields(kinds), F.array(F.when(F.coalesce("n_sections", F.lit(0)) == 0, F.lit("sections")))))
        failed = F.when(F.coalesce("n_blocks", F.lit(0)) == 0, F.coalesce("error", F.lit(status.NO_BLOCKS)))
        order = F.array_intersect(F.array(*[F.lit(k) for k in status.REQUIRED]), lacking)
        rows = told.select("doc_id", failed.alias("error"), F.when(failed.isNull(), order).otherwise(F.array().cast("array<string>")).alias("missing"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
        return rows.select("doc_id", status.status_of(F.col("error"), F.lit(False), F.col("missing")).alias("status"), "missing", "error", "seconds")

    def decoded(self, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(documents, their texts, statuses) of files with name and content, each decoded once."""
        decoded = self.stored(raw.decode_files(files, self.decoder), "decoded")
        texts = decoded.select(F.col("name").alias("doc_id"), F.coalesce("full_text", F.lit("")).alias("full_text"), "error", "seconds")
        documents = self.stored(self.documents(raw.blocks_of(decoded), texts), "documents")
        return documents, texts, self.statuses(documents, texts)

    def write(self, files: DataFrame, output: str, batch: int) -> DataFrame:
        """Decode files, write their documents as a batch, and return their statuses."""
        documents, _, told = self.decoded(files)
        told = self.stored(told, "statuses")
        sinks.write_documents(documents.join(told.where("status <> 'error'").select("doc_id"), "doc_id", "left_semi"), output, batch=batch)
        return told

    def run(self, path: str, output: str, overwrite: bool = False, status_path: str | None = None) -> DataFrame:
        """Decode the files of a folder, write their documents, and return the status of each file in order of its name.

        Files with a document in `output` are skipped unless they are overwritten. Intermediate tables go to `staging`,
        by default a folder beside the output, and are deleted. status_path: where the rows are kept as the run's log.
        A folder without files gives no rows.
        """
        if self.decoder is None:
            raise ValueError("a decoder is needed to read files")
        names = raw.list_files(self.spark, path)
        known = sinks.exists(self.spark, output) and sinks.next_batch(self.spark, output) > 0
        done = gold.read_stems(self.spark, output).select(F.col("stem").alias("name")) if known else self.spark.createDataFrame([], "name string")
        before, at, own = (self.staging, self.images), sinks.next_batch(self.spark, output), output.rstrip("/") + "-staging"
        self.staging, self.images = self.staging or own, self.images or sinks.uri(self.spark, output.rstrip("/") + "-images")
        try:
            skipped = self.stored(status.skipped(names.select("name"), done, "name").select(F.col("name").alias("doc_id")), "skipped") if not overwrite else self.spark.createDataFrame([], "doc_id string")
            wanted = self.stored(status.pending(names.select("path", "name"), done, "name", overwrite).select("path"), "wanted")
            told = self.write(names.join(wanted, "path", "left_semi").select("name", "content"), output, at)
            old = skipped.select("doc_id", F.lit("skipped").alias("status"), F.array().cast("array<string>").alias("missing"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("seconds"))
            log = status_path or output.rstrip("/") + "-status"
            sinks.write_status(told.unionByName(old), log, at)
        finally:
            self.clear()
            self.staging, self.images = before
            if self.staging is None:
                system, where = sinks.file_system(self.spark, own)
                system.delete(where, True)
        return self.spark.read.schema("doc_id string, status string, missing array<string>, error string, seconds double").parquet(f"{log}/batch={at}").orderBy("doc_id")
