"""Completion index: the best entries of every prefix, and deletion neighbourhoods for typing errors, as tables looked up by key.

Entries are texts with frequencies (query_text, frequency), lower-cased and stripped as suggest.insert makes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Entries kept for a prefix; characters of the longest prefix with entries of its own (texts that agree in more are found by it and compared).
BEST, LONGEST = 20, 24
#: Deletions that a typing error may need on either side, and characters of the longest text with neighbours.
DELETIONS, TYPED = 2, 40


@dataclass
class Completion:
    """prefixes (prefix, query_text, frequency, rank), long (head, query_text, frequency), neighbours (variant, query_text, frequency)."""

    prefixes: DataFrame
    long: DataFrame
    neighbours: DataFrame

    def save(self, path: str) -> None:
        """Each table sorted by its key, so that one key's rows are in one row group or two."""
        for name, key in KEYS.items():
            getattr(self, name).repartition(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")


KEYS = {"prefixes": "prefix", "long": "head", "neighbours": "variant"}


def load(spark: SparkSession, path: str) -> Completion:
    return Completion(*(spark.read.parquet(f"{path}/{name}") for name in KEYS))


def variants(text: str, deletions: int = DELETIONS) -> set[str]:
    """The text and what is left of it without one character, two, ... of them."""
    out = last = {text}
    for _ in range(deletions):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = sorted(variants(t))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()), pa.array([t] * len(v), pa.string()), pa.array([f] * len(v), pa.int64())], ["variant", "query_text", "frequency"])


def build(table: DataFrame, best: int = BEST, longest: int = LONGEST, typed: int = TYPED) -> Completion:
    """The index of a table (query_text, frequency).

    A prefix keeps its `best` entries; the limit is applied before rows are dealt out by prefix, so that a letter with most of the texts is no burden of one task.
    """
    t = table.select("query_text", F.col("frequency").cast("long").alias("frequency")).where("query_text is not null and query_text <> ''")
    ends = F.sequence(F.lit(1), F.least(F.length("query_text"), F.lit(longest)))
    each = t.select(F.explode(F.transform(ends, lambda n: F.substring(F.col("query_text"), F.lit(1), n))).alias("prefix"), "query_text", "frequency")
    order = W.partitionBy("prefix").orderBy(F.desc("frequency"), "query_text")
    prefixes = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    long = t.where(F.length("query_text") > longest).select(F.substring("query_text", 1, longest).alias("head"), "query_text", "frequency")
    near = t.where(F.length("query_text") <= typed).mapInArrow(_neighbours, "variant string, query_text string, frequency long")
    return Completion(prefixes, long, near)


def prefix(index: Completion, text: str, limit: int = 10, best: int = BEST, longest: int = LONGEST) -> DataFrame:
    """(query_text, frequency): the same entries as suggest.prefix, from the rows of one key. The index must have been built with the same best and longest."""
    if limit > best:
        raise ValueError(f"the index keeps {best} entries a prefix")
    key = text.lower().strip()
    if not key:
        raise ValueError("a prefix has a character at least")
    if len(key) <= longest:
        return index.prefixes.where((F.col("prefix") == key) & (F.col("rank") <= limit)).select("query_text", "frequency").orderBy(F.desc("frequency"), "query_text")
    return index.long.where((F.col("head") == key[:longest]) & F.col("query_text").startswith(key)).select("query_text", "frequency").orderBy(F.desc("frequency"), "query_text").limit(limit)


def typed(index: Completion, text: str, limit: int = 10, distance: int = DELETIONS) -> DataFrame:
    """(query_text, frequency, distance): entries of TYPED characters at most within an edit distance of the text, nearest first, then most frequent.

    Two texts within d edits have a common text d deletions or less away from each, so the rows of the request's own variants hold all of them; the distance is then worked out.
    """
    if not 0 <= distance <= DELETIONS:
        raise ValueError(f"distance must be 0 to {DELETIONS}")
    key = text.lower().strip()
    met = index.neighbours.where(F.col("variant").isin(sorted(variants(key, distance)))).select("query_text", "frequency").distinct()
    return met.withColumn("distance", F.levenshtein("query_text", F.lit(key))).where(F.col("distance") <= distance).orderBy("distance", F.desc("frequency"), "query_text").limit(limit)
