"""BM25 over an inverted index in tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from .lexical import few_or_merge



@dataclass
class Bm25:
    """postings (term, doc_id, tf, dl), lengths (doc_id, dl), terms (term, df, idf), stats (n, avgdl: one row); by_term: postings of a term are in one partition."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame
    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.0
    by_term: bool = False

    def save(self, path: str) -> None:
        """Each table as Parquet below path, for load(); postings sorted by term, so that a query's terms prune row groups."""
        for name in TABLES:
            rows = getattr(self, name)
            (rows.repartition("term").sortWithinPartitions("term") if name == "postings" else rows).write.mode("overwrite").parquet(f"{path}/{name}")


TABLES = ("postings", "lengths", "terms", "stats")


def load(spark: SparkSession, path: str, k1: float = 1.5, b: float = 0.75, delta: float = 0.0) -> Bm25:
    """A saved index; queries read it without the texts."""
    return Bm25(*(spark.read.parquet(f"{path}/{name}") for name in TABLES), k1, b, delta)


def fit(docs: DataFrame, k1: float = 1.5, b: float = 0.75, delta: float = 0.0, drop_stop_words: bool = True, only: DataFrame | None = None, by_term: bool = False) -> Bm25:
    """Statistics of docs (doc_id, text). With only (term), postings are kept for these terms alone, before any shuffle of all tokens. With by_term, tokens are dealt by their terms, once for all that groups postings by them."""
    t = docs.select("doc_id", tokens(F.col("text"), drop_stop_words).alias("t")).select("doc_id", "t", F.size("t").cast("long").alias("dl"))
    lengths = t.select("doc_id", "dl")
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    wanted = None if only is None else few_or_merge(only.select("term").distinct())

    def kept(words: DataFrame) -> DataFrame:
        return words if wanted is None else words.join(wanted, "term", "left_semi")

    # explode() would test the token list before the texts are dealt out, in the few tasks of a small scan; the outer form does not.
    # The length goes with the words, so that scoring joins postings with nothing as large as the corpus.
    words = kept(t.select("doc_id", "dl", F.explode_outer("t").alias("term")).where("term is not null"))
    if by_term:
        words = words.repartition("term")
    postings = words.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    # Counted from each document's distinct words: partial counts a term are all that is shuffled.
    df = kept(t.select(F.explode_outer(F.array_distinct("t")).alias("term")).where("term is not null")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = df.crossJoin(F.broadcast(stats)).select("term", "df", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    return Bm25(postings, lengths, terms, stats, k1, b, delta, by_term)


def okapi(docs: DataFrame, **options: object) -> Bm25:
    return fit(docs, **options)


def plus(docs: DataFrame, delta: float = 1.0, **options: object) -> Bm25:
    """BM25+: every known query term adds idf * delta, whether or not the document has it."""
    return fit(docs, delta=delta, **options)


def query_terms(queries: DataFrame, drop_stop_words: bool = True) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, query_text); repetition counts."""
    return queries.select("query_id", F.explode(tokens(F.col("query_text"), drop_stop_words)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def score(index: Bm25, queries: DataFrame, drop_stop_words: bool = True) -> DataFrame:
    """(query_id, doc_id, score) of documents with at least one query term; for BM25+ without the part every document gets."""
    q = query_terms(queries, drop_stop_words)
    hits = index.postings.join(few_or_merge(q, q.join(index.terms, "term")), "term").crossJoin(F.broadcast(index.stats))
    tf, norm = F.col("tf"), index.k1 * (1 - index.b + index.b * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * tf * (index.k1 + 1) / (tf + norm)
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def constant(index: Bm25, queries: DataFrame, drop_stop_words: bool = True) -> DataFrame:
    """(query_id, bonus): what BM25+ adds to every document."""
    q = query_terms(queries, drop_stop_words).join(index.terms, "term")
    return q.groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("idf") * index.delta).alias("bonus"))


def score_all(index: Bm25, queries: DataFrame, drop_stop_words: bool = True) -> DataFrame:
    """(query_id, doc_id, score) of every document, zeros included."""
    every = index.lengths.select("doc_id").crossJoin(F.broadcast(queries.select("query_id")))
    out = every.join(score(index, queries, drop_stop_words), ["query_id", "doc_id"], "left")
    if index.delta:
        out = out.join(constant(index, queries, drop_stop_words), "query_id", "left")
        return out.select("query_id", "doc_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    return out.select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_k(index: Bm25, queries: DataFrame, k: int = 5, drop_stop_words: bool = True) -> DataFrame:
    """The k best documents of each query, documents without any of its terms last, by id.

    Only k documents a query can come from outside the scored ones: the least ids, so no query meets the whole corpus.
    """
    from .fusion import top_per_query

    scored = score(index, queries, drop_stop_words)
    filler = index.lengths.select("doc_id").orderBy("doc_id")
    best = top_per_query(scored, k)
    counts = queries.select("query_id").join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"), F.collect_set("doc_id").alias("ids")), "query_id", "left")
    short = counts.where(F.coalesce("have", F.lit(0)) < k)
    extra = short.crossJoin(F.broadcast(filler.limit(2 * k))).where(~F.coalesce(F.array_contains("ids", F.col("doc_id")), F.lit(False))).select("query_id", "doc_id", F.lit(0.0).alias("score"))
    out = top_per_query(best.select("query_id", "doc_id", "score").unionByName(extra), k)
    if index.delta:
        out = out.join(constant(index, queries, drop_stop_words), "query_id", "left").select("query_id", "doc_id", (F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score"), "rank")
    return out


__all__ = ["Bm25", "W", "constant", "fit", "load", "okapi", "plus", "query_terms", "score", "score_all", "top_k"]
