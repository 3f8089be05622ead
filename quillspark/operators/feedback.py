"""Query history and feedback: weights learned from them, statistics, test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_WEIGHTS = (0.7, 0.3)


def learned_weights(history: DataFrame, feedback: DataFrame, least: int = 10, default: tuple[float, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """One row: mean weights over liked feedback rows, the default under `least` of them."""
    liked = history.join(feedback, "query_id").where((F.col("relevance_score") > 0) | F.col("clicked"))
    a = liked.agg(F.avg("semantic_weight").alias("s"), F.avg("lexical_weight").alias("l"), F.count(F.lit(1)).alias("n"))
    return a.select(F.when(F.col("n") >= least, F.col("s")).otherwise(default[0]).alias("semantic_weight"), F.when(F.col("n") >= least, F.col("l")).otherwise(default[1]).alias("lexical_weight"), F.col("n").alias("feedback_rows"))


def query_stats(history: DataFrame, feedback: DataFrame) -> DataFrame:
    h = history.agg(F.count(F.lit(1)).alias("total_queries"), F.count_distinct("query_text").alias("unique_queries"), F.avg("semantic_weight").alias("avg_semantic_weight"))
    f = feedback.agg(F.count(F.lit(1)).alias("total_feedback"), F.coalesce(F.count_if("clicked"), F.lit(0)).alias("total_clicks"), F.avg("relevance_score").alias("avg_relevance"))
    return h.crossJoin(f)


def feedback_test_set(history: DataFrame, feedback: DataFrame) -> DataFrame:
    """(query_text, relevant_doc_ids): documents rated 3 or more or clicked, duplicates kept, sorted."""
    return history.join(feedback, "query_id").where((F.col("relevance_score") >= 3) | F.col("clicked")).groupBy("query_text").agg(F.sort_array(F.collect_list("doc_id")).alias("relevant_doc_ids"))
