"""Composite searches by name. Each takes queries (query_id, query_text), so one query and a batch are the same code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import chunk
from ..functions.snippets import snippets
from ..functions.text import highlight
from ..operators import bm25, fusion, lexical, rag, scan
from ..operators.providers import embed
from ..sources.scratch import stored


class Pipeline:
    """index(docs: doc_id, text) once, then search(queries, k) -> query_id, doc_id, score, rank, content."""

    def __init__(self, encode: Callable | None = None, pair_score: Callable[[str, str], float] | None = None, generate: Callable[[str], str] | None = None, highlights: bool = False, **options: object):
        self.encode, self.pair_score, self.generate, self.highlights, self.options = encode, pair_score, generate, highlights, options
        self.docs: DataFrame | None = None

    def index(self, docs: DataFrame) -> Pipeline:
        self.docs = docs.select("doc_id", "text")
        return self

    # Parts.

    def _semantic(self, queries: DataFrame) -> DataFrame:
        return scan.scores(self.docs, queries, self.encode, lexical=False).withColumnRenamed("s", "score")

    def _hybrid(self, queries: DataFrame) -> DataFrame:
        # Written once, as least and greatest scores are needed before any is scaled.
        both = stored(scan.scores(self.docs, queries, self.encode), "pair-scores")
        return fusion.hybrid_of(both, self.options.get("semantic_weight"), self.options.get("lexical_weight"), few=lexical.few(queries))

    def _bm25(self, queries: DataFrame) -> bm25.Bm25:
        return bm25.fit(self.docs, only=bm25.query_terms(queries))

    def _texts(self, hits: DataFrame, few: bool) -> DataFrame:
        """doc_id and content of what hits may have."""
        return self.docs.select("doc_id", F.col("text").alias("content"))

    def _with_content(self, hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """hits (k at most for each query) with their texts; few of them go to the texts, which are not shuffled then."""
        hits, few = stored(hits, "hits"), lexical.few(queries, k)
        out = (F.broadcast(hits) if few else hits).join(self._texts(hits, few), "doc_id").join(queries.select("query_id", "query_text"), "query_id")
        if self.highlights:
            out = out.withColumn("highlighted", highlight(F.col("content"), F.col("query_text"))).withColumn("snippets", snippets(F.col("content"), F.col("query_text")))
        return out

    def scores(self, queries: DataFrame, k: int) -> DataFrame:
        raise NotImplementedError

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        if self.docs is None:
            raise ValueError("index documents first")
        return self._with_content(self.scores(queries, k), queries, k)


class Basic(Pipeline):
    def scores(self, queries, k):
        return fusion.top_per_query(self._hybrid(queries), k)


class Chunked(Pipeline):
    """Chunks are searched; with return_parent the best chunk of each document counts."""

    def index(self, docs):
        allowed = {"sentence": ("max_sentences", "overlap"), "paragraph": ("min_length", "max_length"), "sliding": ("size", "overlap"), "semantic": ("threshold", "min_length")}
        strategy = self.options.get("strategy", "paragraph")
        chosen = {k: v for k, v in self.options.items() if k in allowed.get(strategy, ())}
        self.parts = lambda d: chunk(d, strategy, **chosen).select(F.xxhash64("doc_id", "chunk_id").alias("doc_id"), F.col("content").alias("text"), F.col("doc_id").alias("parent_id"))
        self.sources = docs.select("doc_id", "text")
        self.docs = self.parts(self.sources)
        return self

    def scores(self, queries, k):
        hits = self._hybrid(queries)
        if self.options.get("return_parent", True):
            best = hits.groupBy("query_id", "parent_id").agg(F.max_by(F.struct("doc_id", "score"), F.struct(F.col("score"), -F.col("doc_id"))).alias("x"))
            hits = best.select("query_id", F.col("x.doc_id").alias("doc_id"), "parent_id", F.col("x.score").alias("score"))
        return fusion.top_per_query(hits, k)

    def _texts(self, hits, few):
        # Only texts with a hit are parted again.
        wanted = hits.select(F.col("parent_id").alias("doc_id")).distinct()
        return self.parts(self.sources.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")).select("doc_id", F.col("text").alias("content"))

    def search(self, queries, k=5):
        out = super().search(queries, k)
        return out.select(*(c for c in out.columns if c != "parent_id"), "parent_id")


class Reranked(Pipeline):
    def scores(self, queries, k):
        n = self.options.get("initial_k", 20)
        first = self._with_content(fusion.top_per_query(self._hybrid(queries), n), queries, n)
        return fusion.rerank(first.drop("rank"), self.pair_score, k).select("query_id", "doc_id", "score", "rank")


class Bm25(Pipeline):
    def index(self, docs):
        self.docs = docs.select("doc_id", "text")
        return self

    def scores(self, queries, k):
        return bm25.top_k(self._bm25(queries), queries, k)


class HybridBm25(Pipeline):
    def scores(self, queries, k):
        fused = fusion.max_norm(self._semantic(queries), bm25.score(self._bm25(queries), queries), self.options.get("semantic_weight", 0.6), self.options.get("bm25_weight", 0.4))
        return fusion.top_per_query(fused, k)


class Rag(Pipeline):
    """Hits are reranked, unless rerank=False; ask() answers from them."""

    def scores(self, queries, k):
        if not self.options.get("rerank", True):
            return fusion.top_per_query(self._hybrid(queries), k)
        first = self._with_content(fusion.top_per_query(self._hybrid(queries), 2 * k), queries, 2 * k)
        return fusion.rerank(first.drop("rank"), self.pair_score, k).select("query_id", "doc_id", "score", "rank")

    def ask(self, queries, k: int = 5):
        return rag.ask(self.search(queries, k), queries, self.generate)


class MultiStage(Pipeline):
    """Semantic, then BM25, then pair scores; each stage replaces the score and cuts."""

    def scores(self, queries, k):
        a, b = self.options.get("stage1_k", 100), self.options.get("stage2_k", 20)
        one = stored(fusion.top_per_query(self._semantic(queries), a).select("query_id", "doc_id"), "stage-one")
        two = one.join(bm25.score(self._bm25(queries), queries), ["query_id", "doc_id"], "left").fillna(0.0, ["score"])
        two = self._with_content(fusion.top_per_query(two, b), queries, b)
        return fusion.rerank(two.drop("rank"), self.pair_score, k).select("query_id", "doc_id", "score", "rank")


class Diversity(Pipeline):
    def scores(self, queries, k):
        first = stored(fusion.top_per_query(self._hybrid(queries), 4 * k).drop("rank"), "first")
        ids = first.select("doc_id").distinct()
        found = stored(self.docs.join(F.broadcast(ids) if lexical.few(queries, 4 * k) else ids, "doc_id", "left_semi"), "found")
        scaled = fusion.minmax(first, out="rel", epsilon=1e-8).join(found.select("doc_id", embed(F.col("text"), self.encode).alias("embedding")), "doc_id")
        order = fusion.mmr(scaled.select("query_id", "doc_id", F.col("rel").alias("score"), "embedding"), k, self.options.get("lam", 0.5))
        return order.drop("score").join(first, ["query_id", "doc_id"]).select("query_id", "doc_id", "score", "rank")


PIPELINES: dict[str, type[Pipeline]] = {"basic": Basic, "chunked": Chunked, "reranked": Reranked, "bm25": Bm25, "hybrid_bm25": HybridBm25, "rag": Rag, "multi_stage": MultiStage, "diversity": Diversity}


def create(name: str, **options: object) -> Pipeline:
    if name not in PIPELINES:
        raise ValueError(f"unknown pipeline {name!r}; one of {sorted(PIPELINES)}")
    return PIPELINES[name](**options)
