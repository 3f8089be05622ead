"""Autocomplete over a table of queries and their frequencies (query_text, frequency)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fuzzy import fuzzy_partial, fuzzy_ratio
from ..functions.text import strip


def insert(queries: DataFrame) -> DataFrame:
    """Frequencies of lower-cased, stripped queries; blank ones are left out. queries: query_text and maybe frequency."""
    n = F.col("frequency") if "frequency" in queries.columns else F.lit(1)
    return queries.select(strip(F.lower("query_text")).alias("query_text"), n.cast("long").alias("n")).where("query_text <> ''").groupBy("query_text").agg(F.sum("n").alias("frequency"))


def record(table: DataFrame, selections: DataFrame) -> DataFrame:
    """The table after more selections."""
    return insert(table.unionByName(insert(selections)))


def prefix(table: DataFrame, text: str, limit: int = 10) -> DataFrame:
    return table.where(F.col("query_text").startswith(text.lower().strip())).orderBy(F.desc("frequency"), "query_text").limit(limit)


def fuzzy(table: DataFrame, text: str, limit: int = 10, distance: int = 2) -> DataFrame:
    """Queries with a ratio of at least 100 - 20 * distance, from the 2 * limit best."""
    scored = table.withColumn("score", fuzzy_ratio(F.lit(text.lower().strip()), F.col("query_text"))).where(F.col("score") >= 100 - 20 * distance)
    return scored.orderBy(F.desc("score"), "query_text").limit(2 * limit).orderBy(F.desc("score"), F.desc("frequency"), "query_text").limit(limit)


def content(terms: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Content terms (term) with a partial ratio of at least 60."""
    return terms.select(F.col("term").alias("query_text")).distinct().withColumn("score", 100 * fuzzy_partial(F.lit(text.lower().strip()), F.col("query_text"))).where("score >= 60").orderBy(F.desc("score"), "query_text").limit(limit)


def suggest(table: DataFrame, text: str, terms: DataFrame | None = None, limit: int = 10, least: int = 2, distance: int = 2) -> DataFrame:
    """(query_text, score, tier): prefix matches at 1 + f / 100, then fuzzy ones at 0.7 + f / 200, then content terms at 0.5; a later tier only fills what the earlier ones leave, and the first tier of a text wins."""
    empty = table.select("query_text", F.lit(0.0).alias("score"), F.lit(0).alias("tier")).limit(0)
    if len(text.strip()) < least:
        return empty
    tiers = prefix(table, text, limit).select("query_text", (1 + F.col("frequency") / 100).alias("score"), F.lit(1).alias("tier"))
    tiers = tiers.unionByName(fuzzy(table, text, limit, distance).select("query_text", (0.7 + F.col("frequency") / 200).alias("score"), F.lit(2).alias("tier")))
    if terms is not None:
        tiers = tiers.unionByName(content(terms, text, limit).select("query_text", F.lit(0.5).alias("score"), F.lit(3).alias("tier")))
    once = tiers.groupBy("query_text").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("x")).select("query_text", (-F.col("x.s")).alias("score"), F.col("x.tier").alias("tier"))
    return once.orderBy("tier", F.desc("score"), "query_text").limit(limit).orderBy(F.desc("score"), "query_text")


def top_queries(table: DataFrame, n: int = 10) -> DataFrame:
    return table.orderBy(F.desc("frequency"), "query_text").limit(n)


def size(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("size"))


__all__ = ["W", "content", "fuzzy", "insert", "prefix", "record", "size", "suggest", "top_queries"]
