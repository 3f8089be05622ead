"""Stand-ins for learned models: deterministic, replaceable by any callable of the same shape."""

from __future__ import annotations

import re
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384
_TOKEN = re.compile(r"[a-z0-9_]+")


_WORD = np.array([chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_" for b in range(256)])
_CRC = np.array([~crc32(bytes([b]), 0xFFFFFFFF) & 0xFFFFFFFF for b in range(256)], dtype=np.uint32)
#: Bytes up to which words are hashed together, a byte of all at a time; longer ones singly.
_LONG = 64


def hashed_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each token (runs of ASCII letters, digits and underscores in lower case), and the place of its text."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join([b"", *raw, b""]), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_WORD[buf])) + 1
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    row = np.repeat(np.arange(len(raw)), np.diff(np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))))
    # Longest first; those of over _LONG bytes come as one size.
    rest = (_LONG + 1 - np.minimum(sizes, _LONG + 1)).astype(np.uint8)
    order = np.argsort(rest, kind="stable")
    at, ends = starts[order], np.cumsum(np.bincount(rest, minlength=_LONG + 1))
    many = int(ends[0])
    out = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(_LONG):
        some = slice(many, int(ends[_LONG - k]))
        if some.start == some.stop:
            break
        crc = out[some]
        out[some] = _CRC[crc.astype(np.uint8) ^ buf[at[some] + k]] ^ (crc >> np.uint32(8))
    out = ~out
    for i in range(many):
        out[i] = crc32(buf[at[i] : at[i] + sizes[order[i]]].tobytes())
    h = np.empty(len(at), dtype=np.int64)
    h[order] = out
    return h, row


def hashed_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Signed feature hashing of tokens, at length 1; texts without tokens are zero."""
    h, row = hashed_tokens(texts)
    out = np.bincount(row * dim + h % dim, np.where(h & 1 << 31, 1.0, -1.0), len(texts) * dim).reshape(len(texts), dim)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def embed(text: Column, encode: Callable[[list[str]], np.ndarray] | None = None) -> Column:
    """Vectors of a text column, in Arrow batches."""
    use = encode or hashed_vectors

    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(list(use(t.fillna("").tolist()).astype("float32")))

    return run(text)


class MultilingualEmbedder:
    """The same interface under its multilingual name."""

    def __init__(self, encode: Callable[[list[str]], np.ndarray] | None = None, dimension: int = DIM):
        self._encode, self.dimension = encode or (lambda t: hashed_vectors(t, dimension)), dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        return self._encode(texts)

    def encode_single(self, text: str) -> np.ndarray:
        return self._encode([text])[0]

    @staticmethod
    def supported_languages() -> list[str]:
        from ..functions.language import SUPPORTED

        return list(SUPPORTED)


def lexical_pair_score(query: str, text: str) -> float:
    """Share of the query's distinct tokens in the text, plus a little for their density."""
    q, t = set(_TOKEN.findall(query.lower())), _TOKEN.findall(text.lower())
    if not q or not t:
        return 0.0
    return len(q & set(t)) / len(q) + 0.1 * sum(w in q for w in t) / len(t)


def extract_answer(prompt: str) -> str:
    """The context's sentence that shares most tokens with the question; a stand-in for a generator."""
    context, _, question = prompt.partition("Question:")
    best = max(re.split(r"(?<=[.!?])\s+|\n+", context.partition("Context:")[2]), key=lambda s: lexical_pair_score(question, s), default="")
    return best.strip()
