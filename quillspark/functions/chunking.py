"""Chunkers: one row of text becomes rows of chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import strip

CHUNK = "doc_id long, chunk_id int, content string, start_char int, end_char int, metadata map<string,string>"
_SENTENCE = r"(?U)(?<=[.!?])\s+"


def _check_windows(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the chunk's size")


def sentence_chunks(docs: DataFrame, max_sentences: int = 3, overlap: int = 1) -> DataFrame:
    """Windows of max_sentences sentences, each starting max_sentences - overlap after the one before; sentences are joined by one space."""
    _check_windows(max_sentences, overlap)
    sentences = F.filter(F.split(strip(F.coalesce("text", F.lit(""))), _SENTENCE), lambda s: s.rlike(r"(?U)\S"))
    # Texts without sentences go after the windows are rows: a filter on the sentences would split every text once more.
    d = docs.select("doc_id", sentences.alias("s"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)), F.lit(max_sentences - overlap))
    # Joined before they become rows, so that no row carries all sentences of its text.
    windows = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("s", i + 1, max_sentences), " ").alias("content"), F.least(F.lit(max_sentences), F.size("s") - i).alias("n")))
    return d.select("doc_id", F.posexplode_outer(windows).alias("chunk_id", "w")).where("w.n > 0").select(
        "doc_id",
        "chunk_id",
        F.col("w.content").alias("content"),
        F.lit(None).cast("int").alias("start_char"),
        F.lit(None).cast("int").alias("end_char"),
        F.create_map(F.lit("sentence_count"), F.col("w.n").cast("string"), F.lit("start_sentence"), F.col("w.at").cast("string")).alias("metadata"),
    )


def sliding_chunks(docs: DataFrame, size: int = 512, overlap: int = 128) -> DataFrame:
    """Windows of size characters every size - overlap; the first that reaches the end is the last. Contents are stripped, blank windows take no id."""
    _check_windows(size, overlap)
    step = size - overlap
    n = F.length("text")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(n > 0)
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: (i == 0) | (i - step + size < n))
    windows = F.filter(F.transform(starts, lambda i: F.struct(i.alias("at"), strip(F.substring(F.col("text"), i + 1, F.lit(size))).alias("content"))), lambda w: F.length(w["content"]) > 0)
    return d.select("doc_id", n.alias("n"), windows.alias("windows")).select("doc_id", "n", F.posexplode_outer("windows").alias("chunk_id", "w")).where("w is not null").select(
        "doc_id", "chunk_id", F.col("w.content").alias("content"), F.col("w.at").alias("start_char"), F.least(F.col("w.at") + size, F.col("n")).alias("end_char"), F.create_map().cast("map<string,string>").alias("metadata")
    )


def split_sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]


def paragraphs_of(text: str, least: int = 50, most: int = 1000) -> list[dict]:
    """Paragraphs merged up to `most` characters; longer ones become windows of five sentences with one in common; a last one under `least` joins the chunk before."""
    out: list[dict] = []
    open_, start = "", 0

    def close() -> None:
        nonlocal open_
        if open_:
            out.append({"content": open_, "start": start, "meta": {}})
            open_ = ""

    for p in (p.strip() for p in re.split(r"\n\s*\n", text.strip())):
        if not p:
            continue
        if len(p) > most:
            close()
            s = split_sentences(p)
            out.extend({"content": " ".join(s[i : i + 5]), "start": None, "meta": {"sentence_count": str(len(s[i : i + 5])), "start_sentence": str(i)}} for i in range(0, len(s), 4))
            continue
        if open_ and len(open_) + len(p) + 1 <= most:
            open_ += "\n\n" + p
        else:
            close()
            open_, start = p, text.find(p)
    if open_ and len(open_) < least and out:
        out[-1]["content"] += "\n\n" + open_
    else:
        close()
    return out


def _per_document(docs: DataFrame, split: Callable[[str], list[dict]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c["content"], c["start"], None, c["meta"]) for i, t in zip(b["doc_id"], b["text"], strict=True) for k, c in enumerate(split(t or ""))]
            out = pd.DataFrame(rows, columns=["doc_id", "chunk_id", "content", "start_char", "end_char", "metadata"])
            yield out.astype({"doc_id": "Int64", "chunk_id": "int32", "start_char": "Int32", "end_char": "Int32"})

    return docs.select("doc_id", "text").mapInPandas(run, CHUNK)


def paragraph_chunks(docs: DataFrame, min_length: int = 50, max_length: int = 1000) -> DataFrame:
    return _per_document(docs, lambda t: paragraphs_of(t, min_length, max_length))


def semantic_of(text: str, embed: Callable[[list[str]], np.ndarray], threshold: float = 0.5, least: int = 100) -> list[dict]:
    """Sentences in order; a chunk ends before one whose cosine with the sentence before is under threshold, once it has `least` characters."""
    s = split_sentences(text)
    if len(s) <= 1:
        return [{"content": text, "start": 0, "meta": {}}] if text.strip() else []
    v = embed(s)
    sizes = np.linalg.norm(v, axis=1)
    out, part = [], [s[0]]
    for i in range(1, len(s)):
        scale = sizes[i - 1] * sizes[i]
        sim = float(v[i - 1] @ v[i] / scale) if scale else 0.0
        if sim < threshold and len(" ".join(part)) >= least:
            out.append({"content": " ".join(part), "start": None, "meta": {"split_similarity": f"{sim:.6f}"}})
            part = []
        part.append(s[i])
    out.append({"content": " ".join(part), "start": None, "meta": {}})
    return out


def semantic_chunks(docs: DataFrame, threshold: float = 0.5, min_length: int = 100, embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    from ..operators.providers import hashed_vectors

    use = embed or hashed_vectors
    return _per_document(docs, lambda t: semantic_of(t, use, threshold, min_length))


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"sentence": sentence_chunks, "paragraph": paragraph_chunks, "sliding": sliding_chunks, "semantic": semantic_chunks}


def chunk(docs: DataFrame, strategy: str = "paragraph", **options: object) -> DataFrame:
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown chunking strategy {strategy!r}; one of {sorted(CHUNKERS)}")
    return CHUNKERS[strategy](docs, **options)
