"""BM25 top-k over postings in blocks with score maxima: blocks that can't reach the kth score are not read.

Documents fall into ranges of consecutive ids, and a term's postings into one block a range. So the blocks of a query's terms line up, and the sum of their maxima bounds every document of the range: what a range may reach is known from a table without ids or counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import bm25
from .fusion import top_per_query
from .lexical import few_or_merge

#: Ids of one range. Smaller ranges have tighter bounds and more blocks.
RANGE = 64
#: Ranges of a query that are scored in the first two rounds, best bounds first; the third takes all that can still matter.
ROUNDS = (4, 64)
#: Bounds and scores are sums of the same doubles in other orders; ranges this close below the kth score are scored, too.
SLACK = 1e-6


@dataclass
class Blocks:
    """blocks (term, block, n, top, docs, tfs, dls), terms (term, df, idf), stats (n, avgdl: one row); top is the largest part of a score in the block before idf."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    k1: float = 1.5
    b: float = 0.75
    by_term: bool = False

    def save(self, path: str) -> None:
        """As Parquet below path, blocks sorted by term and range, so that a query's terms prune row groups and bounds are read without postings."""
        (self.blocks if self.by_term else self.blocks.repartition("term")).sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.selectExpr("*", f"{self.k1}D AS k1", f"{self.b}D AS b").write.mode("overwrite").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> Blocks:
    stats = spark.read.parquet(f"{path}/stats")
    row = stats.collect()[0]
    return Blocks(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"), stats.select("n", "avgdl"), row["k1"], row["b"])


def _part(k1: float, b: float, tf: F.Column, dl: F.Column) -> F.Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))


def build(index: bm25.Bm25) -> Blocks:
    """Blocks of a BM25 index; a block has RANGE documents at most, so building and reading one is bounded, however common its term."""
    postings = index.postings.crossJoin(F.broadcast(index.stats))
    posting = F.struct("doc_id", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))
    block = F.floor(F.col("doc_id") / RANGE).cast("long")
    grouped = postings.groupBy("term", block.alias("block")).agg(F.sort_array(F.collect_list(posting)).alias("p"), F.max(_part(index.k1, index.b, F.col("tf"), F.col("dl"))).alias("top"))
    blocks = grouped.select("term", "block", F.size("p").alias("n"), "top", F.col("p.doc_id").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))
    return Blocks(blocks, index.terms, index.stats, index.k1, index.b, index.by_term)


def _weights(index: Blocks, queries: DataFrame, drop_stop_words: bool) -> DataFrame:
    """(query_id, term, w) of the terms that the index knows; marked for broadcast if few."""
    q = bm25.query_terms(queries, drop_stop_words)
    w = few_or_merge(q).join(index.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    return few_or_merge(q, w)


def _scores(index: Blocks, weights: DataFrame, ranges: DataFrame) -> DataFrame:
    """Whole scores (query_id, doc_id, score) of the documents of ranges (query_id, block)."""
    wanted = ranges.join(weights.select("query_id", "term", "w"), "query_id")
    hits = index.blocks.select("term", "block", "docs", "tfs", "dls").join(wanted, ["term", "block"])
    each = hits.select("query_id", "w", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p")).crossJoin(F.broadcast(index.stats))
    return each.groupBy("query_id", F.col("p.docs").alias("doc_id")).agg(F.sum(F.col("w") * _part(index.k1, index.b, F.col("p.tfs"), F.col("p.dls"))).alias("score"))


def search(index: Blocks, queries: DataFrame, k: int = 5, drop_stop_words: bool = True, rounds: tuple[int, ...] = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, score, rank) of the k best documents with a query term, the same as scoring all, and (query_id, postings, read): postings of the query's terms and those that were scored.

    Each round scores, for every query, the unread ranges with the best bounds whose bound is not below the query's kth score so far; the last round has no limit. Scores of a range are whole, so ranges never meet again.
    """
    weights = _weights(index, queries, drop_stop_words)
    per = index.blocks.select("term", "block", "n", "top").join(weights, "term")
    bounds = stored(per.groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound"), F.sum("n").alias("n")), "bm25-bounds")
    best, kth, read = None, None, None
    seen = bounds.select("query_id", "block").limit(0)
    for most in (*rounds, None):
        open_ = bounds.join(seen, ["query_id", "block"], "left_anti") if best is not None else bounds
        if kth is not None:
            open_ = open_.join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK)).drop("kth")
        if most is not None:
            open_ = top_per_query(open_, most, item="block", score="bound").drop("rank")
        ranges = stored(open_.select("query_id", "block", "n"), "bm25-ranges")
        read = ranges if read is None else read.unionByName(ranges)
        seen = read.select("query_id", "block")
        new = top_per_query(_scores(index, weights, ranges.select("query_id", "block")), k).drop("rank")
        best = stored(new if best is None else top_per_query(best.unionByName(new), k).drop("rank"), "bm25-best")
        kth = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"), F.min("score").alias("kth")).where(F.col("have") == k).select("query_id", "kth")
    report = bounds.groupBy("query_id").agg(F.sum("n").alias("postings")).join(read.groupBy("query_id").agg(F.sum("n").alias("read")), "query_id")
    return top_per_query(best, k), report


def top_k(index: Blocks, queries: DataFrame, k: int = 5, drop_stop_words: bool = True) -> DataFrame:
    return search(index, queries, k, drop_stop_words)[0]
