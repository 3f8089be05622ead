"""Snippets around query words; match positions are needed, so this runs in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HIGHLIGHT_TAGS

_TOKEN = re.compile(r"[a-z0-9_]+")


def snippets_of(text: str | None, query: str | None, length: int = 150, most: int = 3, before: str = "<mark>", after: str = "</mark>", dedupe: bool = False) -> list[str]:
    """Up to `most` windows of `length` characters around whole-word matches, in text order, cut at near spaces, with ellipses and tags.

    With dedupe, a window that starts within `length` characters of an earlier one is passed over. Without a match (or query words) the head of the text is the only snippet.
    """
    text, words = text or "", sorted(set(_TOKEN.findall((query or "").lower())))
    head = text[:length] + ("..." if len(text) > length else "")
    if not words:
        return [head]
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, words)) + r")\b", re.IGNORECASE)
    out, used = [], []
    for m in pattern.finditer(text):
        if len(out) == most:
            break
        at = m.start()
        if dedupe and any(abs(at - u) < length for u in used):
            continue
        used.append(at)
        lo, hi = max(0, at - length // 2), min(len(text), at + length // 2)
        if lo > 0:
            gap = text.rfind(" ", max(0, lo - 20), lo)
            lo = gap + 1 if gap > 0 else lo
        if hi < len(text):
            gap = text.find(" ", hi, min(len(text), hi + 20))
            hi = gap if gap > 0 else hi
        body = pattern.sub(lambda w: before + w[0] + after, text[lo:hi])
        out.append(("..." if lo > 0 else "") + body + ("..." if hi < len(text) else ""))
    return out or [head]


def snippets(text: Column, query: Column, length: int = 150, most: int = 3, style: str = "mark", dedupe: bool = False) -> Column:
    before, after = HIGHLIGHT_TAGS[style]

    @F.pandas_udf("array<string>")
    def run(t: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([snippets_of(x, y, length, most, before, after, dedupe) for x, y in zip(t, q, strict=True)])

    return run(text, query)
