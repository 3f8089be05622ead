"""Fuzzy and token-overlap scores of queries against documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import fuzzy_partial, gram_bound, gram_codes, partial_ratio
from ..functions.text import tokens
from ..sources.scratch import stored
from .fusion import top_per_query


#: Rows of query terms that are broadcast at most.
FEW = 100_000


def few_or_merge(terms: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """rows (terms themselves if not given, else no more of them) marked for broadcast if terms, counted here, are few; otherwise for a merge join.

    Without the count the planner, which guesses sizes from files, may send the corpus's terms to the one task of a query's.
    """
    out = terms if rows is None else rows
    return F.broadcast(out) if terms.select(F.lit(1)).limit(FEW + 1).count() <= FEW else out.hint("merge")


def few(queries: DataFrame, k: int = 1) -> bool:
    """Whether k rows for each query may be broadcast."""
    most = FEW // k
    return queries.select(F.lit(1)).limit(most + 1).count() <= most


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has; 0 without query tokens."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def overlap_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of pairs with a shared token, joined on tokens."""
    q = queries.select("query_id", F.array_distinct(tokens(F.col("query_text"))).alias("t"))
    q = q.select("query_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    d = docs.select("doc_id", F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("term")).where("term is not null")
    return d.join(few_or_merge(q), "term").groupBy("query_id", "doc_id").agg((F.count(F.lit(1)) / F.first("n")).alias("score"))


def hybrid_lexical(docs: DataFrame, queries: DataFrame, fuzzy_weight: float = 0.7, overlap_weight: float = 0.3) -> DataFrame:
    """Weighted fuzzy and overlap score of every pair; where either side has no tokens, the fuzzy score alone."""
    pairs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).crossJoin(queries.select("query_id", "query_text"))
    fuzzy = fuzzy_partial(F.col("query_text"), F.col("text"))
    none = (F.size(tokens(F.col("query_text"))) == 0) | (F.size(tokens(F.col("text"))) == 0)
    return pairs.withColumn("_f", fuzzy).select("query_id", "doc_id", F.when(none, F.col("_f")).otherwise(fuzzy_weight * F.col("_f") + overlap_weight * overlap(F.col("query_text"), F.col("text"))).alias("score"))


_TOKEN = re.compile("[a-z0-9_]+")
#: Queries that go to the documents at once; more of them take further passes.
PORTION = 2000
_PAIRS = "query_id long, doc_id long, score double, compared long"


class _Query:
    def __init__(self, query_id: int, text: str, least: float):
        self.id, self.text, self.least = query_id, text.lower(), least
        self.tokens, self.grams = set(_TOKEN.findall(self.text)), np.unique(gram_codes(self.text))


def _beyond(q: _Query, doc: _Text, weights: tuple[float, float], least: float) -> float | None:
    """Hybrid score of the pair, or None if it is surely below least: first by the tokens, then by the grams, then by stretches of the text."""
    if q.tokens and doc.tokens:
        a, rest = weights[0], weights[1] * len(q.tokens & doc.tokens) / len(q.tokens)
    else:
        a, rest = 1.0, 0.0
    if a + rest < least:
        return None
    if len(q.text) <= len(doc.text) and a * gram_bound(len(q.text), len(doc.text), q.grams, doc.grams()) / 100 + rest < least:
        return None
    f = partial_ratio(q.text, doc.text, 100 * (least - rest) / a)
    return None if f < 0 else a * f / 100 + rest


class _Text:
    def __init__(self, text: str | None):
        self.text = (text or "").lower()
        self.tokens, self._grams = set(_TOKEN.findall(self.text)), None

    def grams(self) -> np.ndarray:
        if self._grams is None:
            self._grams = gram_codes(self.text)
        return self._grams


def hybrid_top_k(docs: DataFrame, queries: DataFrame, k: int = 5, fuzzy_weight: float = 0.7, overlap_weight: float = 0.3, portion: int = PORTION) -> DataFrame:
    """(query_id, doc_id, score, rank, compared): the k best documents of each query by hybrid_lexical's score, the same as of all pairs; compared is how many documents' strings were compared with the query's at all.

    The documents with the most common tokens are scored first, which gives every query a kth score. Then the queries go to the documents, PORTION at a time, without a join; a pair's strings are compared only if its token overlap, and then its grams, allow the kth score that the query has so far (of the first documents, or of the task's own). A task sends k documents a query.
    """
    spark = docs.sparkSession
    weights = (fuzzy_weight, overlap_weight)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("query_text", F.lit("")).alias("query_text")), "queries")
    first = top_per_query(overlap_scores(d, asked), 4 * k).select("query_id", "doc_id")
    pairs = first.join(d, "doc_id").join(asked, "query_id").select("query_id", "doc_id", "query_text", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_beyond(_Query(i, q, -1.0), _Text(t), weights, 0.0) for i, q, t in zip(*(b.column(c).to_pylist() for c in (0, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64())], ["query_id", "doc_id", "score"])

    seeds = top_per_query(pairs.mapInArrow(score, "query_id long, doc_id long, score double"), k)
    kth = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("query_id", "least")
    known = stored(asked.join(kth, "query_id", "left"), "queries-kth")
    parts = -(-known.count() // portion)
    parts += parts > 1  # hashes deal unevenly
    out = spark.createDataFrame([], _PAIRS)
    for p in range(parts):
        rows = (known.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) if parts > 1 else known).collect()
        sent = spark.sparkContext.broadcast([(r["query_id"], r["query_text"], -1.0 if r["least"] is None else r["least"]) for r in rows])

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qs = [_Query(*x) for x in sent.value]
            held: list[list[tuple[float, int, float]]] = [[] for _ in qs]
            compared = [0] * len(qs)
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    doc = _Text(t)
                    for n, q in enumerate(qs):
                        s = _beyond(q, doc, weights, q.least - 1e-8)
                        if s is None:
                            continue
                        compared[n] += 1
                        held[n].append((-round(s, 9), i, s))
                        if len(held[n]) >= 4 * k:
                            held[n] = sorted(held[n])[:k]
                            q.least = max(q.least, -held[n][-1][0])
            rows = [(q.id, i, s, c) for q, h, c in zip(qs, held, compared, strict=True) for _, i, s in sorted(h)[:k]]
            # Comparisons are counted on a row of their own, as a task may have no document to send.
            rows += [(q.id, None, None, c) for q, c in zip(qs, compared, strict=True) if c]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["query_id", "doc_id", "score", "compared"])

        out = out.unionByName(d.mapInArrow(best, _PAIRS))
    out = stored(out, "lexical-best")
    work = out.where("doc_id is null").groupBy("query_id").agg(F.sum("compared").alias("compared"))
    return top_per_query(out.where("doc_id is not null").drop("compared"), k).join(work, "query_id")
