"""Command line: structure the files of a folder, or one file, with plug-ins named as module:function."""

from __future__ import annotations

import argparse
import importlib
import os
from datetime import date

from pyspark.sql import SparkSession

from papyrine.operators import status
from papyrine.plans.engine import Engine

PLUGINS = ("decoder", "ocr", "layout_detector", "equation_detector", "crossref", "llm", "vlm", "renderer")


def plugin(name: str | None):
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="papyrine", description=__doc__)
    parser.add_argument("--input", required=True, help="a folder, or one file")
    parser.add_argument("--output", required=True, help="where documents go; statuses go beside it")
    parser.add_argument("--overwrite", action="store_true", help="also files that have a document")
    parser.add_argument("--workers", type=int, help="cores, in local mode")
    parser.add_argument("--log-level", default="WARN")
    parser.add_argument("--offline", action="store_true", help="no look-ups over a network")
    for name, text in (("extract-images", "figures and tables"), ("crossref", "the look-up of DOIs"), ("llm", "the language model")):
        parser.add_argument(f"--{name}", dest=f"use_{name.replace('-', '_')}", action=argparse.BooleanOptionalAction, default=True, help=text)
    parser.add_argument("--as-of-year", type=int, default=date.today().year, help="the latest year a document may be of, less one")
    for name in PLUGINS:
        parser.add_argument(f"--plugin-{name.replace('_', '-')}", dest=name, metavar="MODULE:FUNCTION", required=name == "decoder")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if the input does not exist. Prints a line for each status and the summary."""
    asked = arguments().parse_args(argv)
    builder = SparkSession.builder.appName("papyrine")
    spark = spark or (builder.master(f"local[{asked.workers}]") if asked.workers else builder).getOrCreate()
    spark.sparkContext.setLogLevel(asked.log_level.upper())
    from papyrine.sources.sinks import exists

    if not exists(spark, asked.input):
        print(f"no such path: {asked.input}")
        return 1
    plugins = {name: plugin(getattr(asked, name)) for name in PLUGINS}
    for name in ("crossref", "llm"):
        if not getattr(asked, f"use_{name}"):
            plugins[name] = None
    engine = Engine(spark, asked.as_of_year, offline=asked.offline, extract_images=asked.use_extract_images, **plugins)
    told = engine.run(asked.input, asked.output, overwrite=asked.overwrite)
    summary = status.summarize(told).head().asDict()
    for row in told.select("doc_id", "status", "seconds", "error").toLocalIterator():
        print(f"{row.doc_id}: {row.status} in {row.seconds:.2f} s" + (f" ({row.error})" if row.error else ""))
    print(", ".join(f"{k} {v:.1f}" if isinstance(v, float) else f"{k} {v}" for k, v in summary.items()))
    return 0


if __name__ == "__main__":
    os._exit(main())
