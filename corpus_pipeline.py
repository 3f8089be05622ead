"""Corpus cleaning from raw documents to token ids, in five stages.

Every stage takes what its predecessor kept, and its decisions take effect: toxic documents go, one document of each near-duplicate group stays, passages of an earlier document are cut, documents that hold a benchmark item go, and what is left is encoded.

All stages take any table with doc_id and text, other columns (of clashing names, too) pass through but for the last, and an empty table stays empty. Rows are judged by id and text: a null text is an empty one, which the later stages leave alone; of rows equal in id and text the second stage keeps one, and the others decide them alike; a row with a null doc_id has no place in the order of documents and is never taken for a copy. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe_codec, compact_windows, decontamination, minhash, toxicity
from quillspark.llm.common import stored, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic by their nearest labelled examples go; null and empty texts are scored by the labelled ones of that kind, and without labelled examples nothing goes."""
    tune(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the one with the least id stays."""
    tune(spark)
    return minhash.keep_one(docs, width=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that resemble one of an earlier document are cut; of two equal passages the one in the document with the lesser id stays, and texts under 50 words are left alone."""
    tune(spark)
    return compact_windows.remove_passages(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover a benchmark item go; items under five words match nothing, and an empty benchmark drops nothing."""
    tune(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the text they decode to; a null text has no ids."""
    tune(spark)
    return bpe_codec.encoded(docs)


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeated_passages), ("benchmark_decontamination", drop_contaminated), ("bpe_encoding", encode)]

#: Nearest neighbours and similarity groups are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
