"""Command line: search, index, add, stats, export, import."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import preview
from .engine import Engine


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillspark")
    p.add_argument("--store", default="corpus")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-k", type=int, default=5)
    s.add_argument("--pipeline", default="basic")
    s.add_argument("--where")
    sub.add_parser("index").add_argument("directory")
    sub.add_parser("add").add_argument("texts", nargs="+")
    sub.add_parser("stats")
    sub.add_parser("export").add_argument("-o", "--output", required=True)
    sub.add_parser("import").add_argument("-i", "--input", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    e = Engine(spark, a.store)
    if a.command == "search":
        e.search(a.query, a.k, a.pipeline, a.where).select("rank", "score", "doc_id", preview(F.col("content"), 80).alias("content")).orderBy("rank").show(truncate=False)
    elif a.command == "index":
        print(e.index_directory(a.directory).count(), "documents")
    elif a.command == "add":
        print(e.add(spark.createDataFrame([(t, "") for t in a.texts], "content string, source_path string")).count(), "documents")
    elif a.command == "stats":
        e.stats().show(vertical=True)
    elif a.command == "export":
        e.store.export_json(a.output)
    else:
        print(e.store.import_json(a.input).count(), "documents")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
