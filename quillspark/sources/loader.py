"""Files to documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise, text_stats, word_count

#: File suffixes taken by default.
SUFFIXES = (".txt", ".md", ".log", ".json", ".csv")


def flatten_json(raw: str) -> str:
    """String values of an object or string items of a list, joined by spaces; another value as text; invalid JSON is empty."""
    try:
        x = json.loads(raw)
    except ValueError:
        return ""
    if isinstance(x, dict):
        return " ".join(v for v in x.values() if isinstance(v, str))
    if isinstance(x, list):
        return " ".join(v for v in x if isinstance(v, str))
    return str(x)


def load(spark: SparkSession, path: str | list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(source_path, raw) of the files below path (or of the listed files) with one of the suffixes, in any case; undecodable bytes make a file empty."""

    @F.pandas_udf("string")
    def decode(content: pd.Series, name: pd.Series) -> pd.Series:
        out = []
        for c, n in zip(content, name, strict=True):
            try:
                t = bytes(c).decode("utf-8")
            except UnicodeDecodeError:
                t = ""
            out.append(flatten_json(t) if n.lower().endswith(".json") else t)
        return pd.Series(out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)
    return files.where(wanted).select(F.col("path").alias("source_path"), decode("content", "path").alias("raw"))


def discover(spark: SparkSession, path: str | list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(source_path, content, stats): normalised contents and statistics of the raw ones; blank files are left out."""
    return load(spark, path, suffixes).select("source_path", normalise(F.col("raw")).alias("content"), text_stats(F.col("raw")).alias("stats")).where("content <> ''")


def spread(rows: DataFrame) -> DataFrame:
    """rows of a file scan, dealt out evenly if it has fewer splits than there are cores (few or unsplittable files); else as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def from_list(spark: SparkSession, texts: list[str], paths: list[str] | None = None) -> DataFrame:
    """The corpus frame of a list: doc_id, content, source_path, char_count, word_count."""
    paths = paths or [""] * len(texts)
    rows = [(i, t, p) for i, (t, p) in enumerate(zip(texts, paths, strict=True))]
    return corpus_frame(spark.createDataFrame(rows, "doc_id long, content string, source_path string"))


def corpus_frame(rows: DataFrame, normal: bool = False) -> DataFrame:
    return rows.select("doc_id", "content", "source_path", F.length("content").alias("char_count"), word_count(F.col("content"), normal).alias("word_count"))
