"""Score normalisation, fusion, top-k and reranking."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .providers import lexical_pair_score


def top_per_query(scores: DataFrame, k: int, key: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank; equal scores (to 9 digits) by id."""
    w = W.partitionBy(key).orderBy(F.round(score, 9).desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top(scores: DataFrame, k: int, item: str = "doc_id", score: str = "score") -> DataFrame:
    return scores.orderBy(F.round(score, 9).desc(), F.col(item)).limit(k)


def minmax(scores: DataFrame, col: str = "score", key: str = "query_id", out: str | None = None, epsilon: float = 0.0) -> DataFrame:
    """col scaled to 0..1 for each query; equal scores all become 1. An empty table stays empty."""
    ends = scores.groupBy(key).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    x = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + epsilon))
    return scores.join(ends, key).withColumn(out or col, x).drop("_lo", "_hi")


def check_weights(a: float | None, b: float | None, default: tuple[float, float] = (0.7, 0.3)) -> tuple[float, float]:
    """Both weights; one alone is completed to 1, and they must sum to 1."""
    if a is None and b is None:
        return default
    a = 1 - b if a is None else a
    b = 1 - a if b is None else b
    if not math.isclose(a + b, 1.0):
        raise ValueError("weights must sum to 1")
    return a, b


def hybrid(semantic: DataFrame, lexical: DataFrame, semantic_weight: float | None = None, lexical_weight: float | None = None) -> DataFrame:
    """Weighted sum of both scores after min-max; documents that one side lacks count 0 there."""
    both = semantic.select("query_id", "doc_id", F.col("score").alias("s")).join(lexical.select("query_id", "doc_id", F.col("score").alias("l")), ["query_id", "doc_id"], "full_outer").fillna(0.0, ["s", "l"])
    return hybrid_of(both, semantic_weight, lexical_weight)


def hybrid_of(both: DataFrame, semantic_weight: float | None = None, lexical_weight: float | None = None, few: bool = False) -> DataFrame:
    """The same of both scores of a pair in one row: s, l, and columns that stay; few: queries are so few that they may be broadcast."""
    a, b = check_weights(semantic_weight, lexical_weight)
    ends = both.groupBy("query_id").agg(*(f(c).alias(f"{c}{n}") for c in "sl" for f, n in ((F.min, 0), (F.max, 1))))
    scaled = lambda c: F.when(F.col(f"{c}1") == F.col(f"{c}0"), F.lit(1.0)).otherwise((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")))
    rest = [c for c in both.columns if c not in ("query_id", "doc_id", "s", "l")]
    return both.join(F.broadcast(ends) if few else ends, "query_id").select("query_id", "doc_id", *rest, (a * scaled("s") + b * scaled("l")).alias("score"))


def max_norm(semantic: DataFrame, bm25: DataFrame, semantic_weight: float = 0.6, bm25_weight: float = 0.4) -> DataFrame:
    """Weighted sum of both scores over their maxima; a maximum of 0 or less counts as 1."""
    both = semantic.select("query_id", "doc_id", F.col("score").alias("s")).join(bm25.select("query_id", "doc_id", F.col("score").alias("l")), ["query_id", "doc_id"], "full_outer").fillna(0.0, ["s", "l"])
    both = stored(both, "both-scores")  # read for the maxima, too
    top_ = both.groupBy("query_id").agg(F.max("s").alias("sm"), F.max("l").alias("lm"))
    over = lambda c: F.col(c) / F.when(F.col(c + "m") > 0, F.col(c + "m")).otherwise(F.lit(1.0))
    return both.join(top_, "query_id").select("query_id", "doc_id", (semantic_weight * over("s") + bm25_weight * over("l")).alias("score"))


def rerank(candidates: DataFrame, pair_score: Callable[[str, str], float] | None = None, k: int | None = None) -> DataFrame:
    """Scores of (query_text, content) pairs replace score; candidates: query_id, query_text, doc_id, content, score."""
    use = pair_score or lexical_pair_score

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([use(a or "", b or "") for a, b in zip(q, t, strict=True)], dtype="float64")

    out = candidates.withColumn("score", run("query_text", "content"))
    return top_per_query(out, k) if k else out


def rerank_fusion(candidates: DataFrame, pair_score: Callable[[str, str], float] | None = None, original_weight: float = 0.3, rerank_weight: float = 0.7, k: int | None = None) -> DataFrame:
    """Both scores scaled to 0..1 where they differ (else as they are), weighted."""
    again = rerank(candidates.withColumn("_was", F.col("score")), pair_score)
    ends = again.groupBy("query_id").agg(*(f(c).alias(f"{c}_{n}") for c in ("_was", "score") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    scaled = lambda c: F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), (F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo"))).otherwise(F.col(c))
    out = again.join(ends, "query_id").withColumn("score", original_weight * scaled("_was") + rerank_weight * scaled("score")).select(*candidates.columns)
    return top_per_query(out, k) if k else out


def rerank_late_interaction(candidates: DataFrame, k: int = 5) -> DataFrame:
    """Placeholder for late interaction: the head of the ranking."""
    return top_per_query(candidates, k)


RERANKERS: dict[str, Callable[..., DataFrame]] = {"cross-encoder": rerank, "colbert": rerank_late_interaction}


def reranker(kind: str = "cross-encoder") -> Callable[..., DataFrame]:
    if kind not in RERANKERS:
        raise ValueError(f"unknown reranker {kind!r}; one of {sorted(RERANKERS)}")
    return RERANKERS[kind]


def mmr(candidates: DataFrame, k: int = 5, lam: float = 0.5) -> DataFrame:
    """Greedy maximal marginal relevance in each query's candidates (query_id, doc_id, score, embedding); returns query_id, doc_id, score, rank.

    Candidates are cut to a few times k before, so a group is small. Ties go to the better, then smaller id.
    """
    import numpy as np

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack([np.asarray(x, dtype=float) for x in g["embedding"]])
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(n == 0, 1, n)
        rel, near = g["score"].to_numpy(), np.zeros(len(g))
        left, order = list(range(len(g))), []
        while left and len(order) < k:
            worth = lam * rel[left] - (1 - lam) * near[left]
            best = left.pop(int(np.argmax(np.round(worth, 12))))
            order.append(best)
            sim = v @ v[best]
            near = sim.copy() if len(order) == 1 else np.maximum(near, sim)
        out = g.loc[order, ["query_id", "doc_id", "score"]]
        return out.assign(rank=range(1, len(order) + 1))

    return candidates.select("query_id", "doc_id", F.col("score").cast("double").alias("score"), "embedding").groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, score double, rank int")
