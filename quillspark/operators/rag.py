"""Context building and question answering over search hits; generators are plain callables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import preview
from .providers import extract_answer

MAX_DOCS, MAX_CHARS = 5, 4000


def context(hits: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(query_id, context): the first max_docs hits (query_id, rank, content) under numbered headers, max_chars characters of content in all, the last one cut."""
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    h = hits.where(F.col("rank") <= max_docs).select("query_id", "rank", F.coalesce("content", F.lit("")).alias("content"))
    h = h.withColumn("before", F.coalesce(F.sum(F.length("content")).over(w), F.lit(0))).where(F.col("before") < max_chars)
    part = F.concat(F.lit("[Document "), F.col("rank").cast("string"), F.lit("]\n"), F.substring(F.col("content"), F.lit(1), (max_chars - F.col("before")).cast("int")))
    return h.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


def prompt(query: Column, ctx: Column) -> Column:
    """Instruction, context and question, the answer left open."""
    head = "Use only the context to answer. Say so if it does not hold the answer."
    return F.concat(F.lit(f"{head}\n\nContext:\n"), ctx, F.lit("\n\nQuestion: "), query, F.lit("\n\nAnswer:"))


def ask(hits: DataFrame, queries: DataFrame, generate: Callable[[str], str] | None = None, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(query_id, query_text, answer, sources): hits (query_id, rank, doc_id, score, content) of queries (query_id, query_text); sources carry 200-character previews."""
    use = generate or extract_answer

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return p.map(use)

    sources = hits.where(F.col("rank") <= max_docs).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", preview(F.col("content"), 200).alias("preview")))).alias("sources"))
    x = queries.join(context(hits, max_docs, max_chars), "query_id", "left").join(sources, "query_id", "left")
    ctx = F.coalesce("context", F.lit(""))
    return x.select("query_id", "query_text", F.when(ctx == "", F.lit("No relevant documents found.")).otherwise(run(prompt(F.col("query_text"), ctx))).alias("answer"), "sources")


def hyde(search: Callable[[DataFrame], DataFrame], queries: DataFrame, generate: Callable[[str], str] | None = None) -> DataFrame:
    """Hits for a hypothetical document in place of each query; without a generator the query itself."""
    if generate is None:
        return search(queries)

    @F.pandas_udf("string")
    def run(q: pd.Series) -> pd.Series:
        return q.map(generate)

    return search(queries.withColumn("query_text", run("query_text")))


def agentic(search: Callable[[str, int], list[dict]], query: str, decide: Callable[[str, list[dict], int], str | None] | None = None, generate: Callable[[str], str] | None = None, rounds: int = 3, k: int = 5) -> dict:
    """Up to `rounds` searches; decide sees the query, the hits (previews of three) and the round, and returns the next query or None to stop. Answers from the distinct hits.

    search returns at most k rows a call, so the driver holds rounds * k of them.
    """
    hits: dict[int, dict] = {}
    asked, text = [], query
    for i in range(rounds):
        asked.append(text)
        for h in search(text, k):
            hits.setdefault(h["doc_id"], h)
        if decide is None or i + 1 == rounds:
            break
        nxt = decide(query, [{**h, "content": h["content"][:100]} for h in list(hits.values())[:3]], i)
        if not nxt:
            break
        text = nxt
    best = sorted(hits.values(), key=lambda h: (-h["score"], h["doc_id"]))[:k]
    ctx = "\n\n".join(f"[Document {i}]\n{h['content']}" for i, h in enumerate(best, 1))
    return {"query": query, "searches": asked, "answer": (generate or extract_answer)(f"Context:\n{ctx}\n\nQuestion: {query}\n\nAnswer:") if best else "No relevant documents found.", "sources": best}


def parse_decision(reply: str) -> str | None:
    """DONE stops; SEARCH: text goes on with it; anything else stops."""
    reply = reply.strip()
    return reply[7:].strip() or None if reply.upper().startswith("SEARCH:") else None


def decider(generate: Callable[[str], str]) -> Callable[[str, list[dict], int], str | None]:
    """A decide for agentic(): the generator is shown the question and the previews of what was found, and replies as parse_decision reads it."""

    def decide(query: str, hits: list[dict], _round: int) -> str | None:
        found = "\n".join(f"{n}. {h['content']}" for n, h in enumerate(hits, 1)) or "(nothing)"
        return parse_decision(generate(f"Question: {query}\n\nFound so far:\n{found}\n\nReply DONE if this is enough to answer. Otherwise reply SEARCH: followed by a better query."))

    return decide
