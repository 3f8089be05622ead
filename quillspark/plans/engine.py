"""The engine: a stored corpus with search, feedback, suggestions, caching and jobs around it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import compile_filter
from ..functions.language import detect, fit_profiles
from ..functions.snippets import snippets
from ..functions.text import highlight, language_name
from ..operators import dedup, feedback, fusion, rag, suggest
from ..operators.cache import MemoryCache
from ..shipping import ship
from ..sources.store import Store
from ..streaming.jobs import JobQueue
from ..streaming.stateful import auto_index
from .pipelines import create


def _check(name: str, value: float, lo: float, hi: float) -> None:
    if not lo <= value <= hi:
        raise ValueError(f"{name} must be {lo} to {hi}")


class Engine:
    def __init__(self, spark: SparkSession, path: str, encode: Callable | None = None, pair_score: Callable | None = None, generate: Callable | None = None):
        ship(spark)
        self.spark, self.store = spark, Store(spark, path).create()
        self.parts = {"encode": encode, "pair_score": pair_score, "generate": generate}
        self.cache = MemoryCache()

    # Indexing.

    def index(self, rows: DataFrame) -> DataFrame:
        return self.store.replace(rows)

    def index_directory(self, path: str) -> DataFrame:
        return self.store.replace_from(path)

    def add(self, rows: DataFrame) -> DataFrame:
        return self.store.add(rows)

    def jobs(self, **options: object) -> JobQueue:
        """A queue whose tasks are frames of rows to add."""
        return JobQueue(self.spark, lambda rows, report: self.store.add(rows).count(), **options)

    def watch(self, path: str):
        return auto_index(self.spark, path, self.store)

    # Search.

    def _corpus(self, where: str | None = None, language: str | None = None) -> DataFrame:
        d = self.store.read("docs")
        if where:
            d = d.where(compile_filter(F.col("metadata"), where))
        if language:
            d = d.where(F.col("language") == language)
        return d.select("doc_id", F.col("content").alias("text"))

    def search(self, queries: DataFrame | str, k: int = 5, pipeline: str = "basic", where: str | None = None, language: str | None = None, highlights: bool = False, log: bool = True, learned: bool = False, mode: str = "pre", **options: object) -> DataFrame:
        """Hits of one query or of queries (query_id, query_text); metadata and language filters come before scoring or, with mode="post", thin out the best 3k hits, which may leave less than k."""
        _check("k", k, 1, 100)
        for name in ("semantic_weight", "lexical_weight"):
            if options.get(name) is not None:
                _check(name, options[name], 0, 1)
        if mode not in ("pre", "post"):
            raise ValueError(f"unknown mode {mode!r}")
        q = self._queries(queries)
        if learned:
            w = feedback.learned_weights(self.store.read("query_history"), self.store.read("feedback")).collect()[0]
            options |= {"semantic_weight": w["semantic_weight"], "lexical_weight": w["lexical_weight"]}
        elif pipeline == "basic":
            a, b = fusion.check_weights(options.get("semantic_weight"), options.get("lexical_weight"))
            options |= {"semantic_weight": a, "lexical_weight": b}
        post = mode == "post" and bool(where or language)
        searcher = create(pipeline, highlights=highlights, **self.parts, **options)
        out = searcher.index(self._corpus() if post else self._corpus(where, language)).search(q, 3 * k if post else k)
        if post:
            document = "parent_id" if "parent_id" in out.columns else "doc_id"
            allowed = self._corpus(where, language).select(F.col("doc_id").alias(document))
            out = fusion.top_per_query(out.drop("rank").join(allowed, document, "left_semi"), k)
        if log:
            self.log_queries(q, k, options.get("semantic_weight"), options.get("lexical_weight"))
        return out

    def _queries(self, queries: DataFrame | str) -> DataFrame:
        return self.spark.createDataFrame([(self._next("query_history", "query_id"), queries)], "query_id long, query_text string") if isinstance(queries, str) else queries

    def _next(self, table: str, col: str) -> int:
        return self.store.read(table).agg(F.coalesce(F.max(col), F.lit(0)).alias("m")).collect()[0]["m"] + 1

    def log_queries(self, queries: DataFrame, k: int, a: float | None, b: float | None) -> None:
        self.store.append("query_history", queries.select("query_id", "query_text", F.lit(a).cast("double").alias("semantic_weight"), F.lit(b).cast("double").alias("lexical_weight"), F.lit(k).alias("top_k"), F.localtimestamp().alias("ts")))
        self.store.append("suggestions", suggest.insert(queries.select("query_text")))  # summed on read

    def suggestions(self) -> DataFrame:
        """(query_text, frequency) of all searches logged."""
        return suggest.insert(self.store.read("suggestions"))

    def feedback(self, query_id: int, doc_id: int, relevance: int = 0, clicked: bool = False) -> int:
        _check("relevance", relevance, 0, 5)
        fid = self._next("feedback", "feedback_id")
        self.store.append("feedback", self.spark.createDataFrame([(fid, query_id, doc_id, relevance, clicked)], "feedback_id long, query_id long, doc_id long, relevance_score int, clicked boolean").withColumn("ts", F.localtimestamp()))
        return fid

    def highlight(self, hits: DataFrame, style: str = "mark", length: int = 150) -> DataFrame:
        _check("snippet length", length, 50, 500)
        return hits.withColumn("highlighted", highlight(F.col("content"), F.col("query_text"), style)).withColumn("snippets", snippets(F.col("content"), F.col("query_text"), length, style=style))

    def rerank(self, query: str, ids: list[int], k: int | None = None) -> DataFrame:
        """Stored documents of the ids (of one request) by pair score; unknown ids raise."""
        found = self._corpus().where(F.col("doc_id").isin(ids)).select(F.lit(0).cast("long").alias("query_id"), F.lit(query).alias("query_text"), "doc_id", F.col("text").alias("content"), F.lit(0.0).alias("score"))
        if found.count() < len(set(ids)):
            raise KeyError("some documents are not in the corpus")
        return fusion.rerank(found, self.parts["pair_score"], k or len(ids))

    def ask(self, query: str, k: int = 5) -> DataFrame:
        _check("k", k, 1, 10)
        q = self._queries(query)
        return rag.ask(self.search(q, k, "rag", log=False), q, self.parts["generate"])

    def suggest(self, text: str, limit: int = 10) -> DataFrame:
        _check("limit", limit, 1, 50)
        return suggest.suggest(self.suggestions(), text, limit=limit)

    # Upkeep.

    def detect_languages(self, labelled: DataFrame) -> None:
        """Fill the language column with a detector fitted on labelled (text, lang)."""
        profiles = fit_profiles(labelled)
        self.store.update("docs", lambda docs: docs.withColumn("language", detect(F.col("content"), profiles)["language"]))

    def languages(self) -> DataFrame:
        return self.store.read("docs").groupBy("language").agg(F.count(F.lit(1)).alias("n")).withColumn("name", language_name(F.col("language")))

    def duplicates(self, threshold: float = 0.9) -> DataFrame:
        return dedup.duplicate_list(self.store.read("docs").select("doc_id", F.col("content").alias("text")), threshold)

    def mark_duplicates(self, threshold: float = 0.9) -> None:
        self.store.update("docs", lambda docs: dedup.mark(docs, dedup.handle(docs.select("doc_id", F.col("content").alias("text")), "flag", threshold)))

    def stats(self) -> DataFrame:
        """One row: documents, query and feedback counts and means."""
        return self.store.read("docs").agg(F.count(F.lit(1)).alias("total_documents")).crossJoin(feedback.query_stats(self.store.read("query_history"), self.store.read("feedback")))

    def cache_stats(self) -> dict:
        return self.cache.stats()

    def clear_cache(self) -> int:
        """Empty the cache; how many entries it had."""
        return self.cache.clear()

    def metadata(self, doc_id: int) -> str | None:
        return self.store.metadata(doc_id)

    def set_metadata(self, updates: DataFrame) -> None:
        self.store.set_metadata(updates)

    def health(self) -> dict:
        return {"status": "healthy", "documents": self.store.read("docs").count(), "version": self.store.version()}
