"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1", "mrr", "ndcg")


def per_query(retrieved: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query_id and METRICS, from retrieved (query_id, doc_id, rank) and relevant (query_id, doc_id); queries of either side, 0 where nothing is found or wanted.

    precision is over the documents retrieved up to k, recall over all relevant rows; the reciprocal rank looks at the whole list; gains are binary, the ideal has the first k relevant rows.
    """
    want = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    hit = retrieved.join(relevant.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return _metrics(hit, want, k)


def per_query_by_label(retrieved: DataFrame, items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The same where all items (doc_id, label) of a query's label (query_id, label) are relevant but for the one of the query's own id. Relevant rows are counted by label and never written out, as there are as many as queries times items of a label."""
    items = items.select("doc_id", "label").where("label is not null")
    own = items.groupBy(F.col("doc_id").alias("query_id"), "label").agg(F.count(F.lit(1)).alias("own"))
    sizes = items.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    want = queries.join(sizes, "label").join(own, ["query_id", "label"], "left").select("query_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("wanted")).where("wanted > 0")
    same = retrieved.join(queries.select("query_id", "label"), "query_id", "left").join(items.distinct().withColumn("hit", F.lit(1)), ["doc_id", "label"], "left")
    return _metrics(same.withColumn("hit", F.when(F.col("doc_id") != F.col("query_id"), F.col("hit"))), want, k)


def _metrics(hit: DataFrame, want: DataFrame, k: int) -> DataFrame:
    """METRICS of hit (query_id, doc_id, rank, hit: 1 or null) and want (query_id, wanted)."""
    inside = (F.col("rank") <= k) & (F.col("hit") == 1)
    got = hit.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("seen"),
        F.count_if(inside).alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    x = got.join(want, "query_id", "full_outer").fillna(0, ["seen", "hits", "wanted"]).fillna(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    p = F.when(F.col("seen") > 0, F.col("hits") / F.col("seen")).otherwise(0.0)
    r = F.when(F.col("wanted") > 0, F.col("hits") / F.col("wanted")).otherwise(0.0)
    return x.select("query_id", p.alias("precision"), r.alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("wanted") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg")).select(
        "query_id", "precision", "recall", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1"), "mrr", "ndcg"
    )


def report(metrics: DataFrame, *keys: str) -> DataFrame:
    """Means of METRICS and the number of queries, for each value of keys (say a configuration)."""
    return metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_queries"), *(F.avg(m).alias(f"avg_{m}") for m in METRICS))


def latency_report(latencies: DataFrame, *keys: str, col: str = "latency_ms") -> DataFrame:
    return latencies.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_queries"), F.avg(col).alias("avg_latency_ms"), *(F.percentile(col, F.lit(q / 100)).alias(f"p{q}_latency_ms") for q in (50, 95, 99)))


def load_test_set(spark, path: str) -> DataFrame:
    """(query_id, query_text, relevant_doc_ids) of a JSON list of {query, relevant_doc_ids}."""
    raw = spark.read.schema("query string, relevant_doc_ids array<long>").json(path, multiLine=True)
    return raw.select(F.xxhash64("query").alias("query_id"), F.col("query").alias("query_text"), "relevant_doc_ids")


def save_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def summary(rows: DataFrame) -> str:
    """A report as text, a line a row; rows come to the driver a partition at a time."""
    return "\n".join(", ".join(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in r.asDict().items()) for r in rows.toLocalIterator())
