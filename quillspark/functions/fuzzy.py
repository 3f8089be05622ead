"""Fuzzy string ratios from the longest common subsequence, bit-parallel on Python integers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one bit for each character of a."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * LCS / (len(a) + len(b)); 100 for two empty strings."""
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def partial_ratio(a: str, b: str, least: float = -1.0) -> float:
    """The best ratio of the shorter string with any window of the longer one of its length, or a shorter window at either end; -1 if that is below least, which can be known much earlier."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        best = 100.0 if not t else 0.0
    elif s in t:
        best = 100.0
    else:
        best = _windows(s, t, max(least - 1e-7, _ends(s, t), _ends(s[::-1], t[::-1])))
    return best if best >= least else -1.0


def _ends(s: str, t: str) -> float:
    """The best ratio of s with the first characters of t, fewer than s has."""
    m = len(s)
    masks: dict[str, int] = {}
    for i, ch in enumerate(s):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = state = (1 << m) - 1
    best = 0.0
    for i, ch in enumerate(t[: m - 1], 1):
        u = state & masks.get(ch, 0)
        if u:
            state = ((state + u) | (state - u)) & full
            best = max(best, 200.0 * (m - state.bit_count()) / (m + i))
    return best


def _windows(s: str, t: str, least: float) -> float:
    """The best ratio of s with a window of t of its length, or least if none is better.

    Windows that begin in [x, x + h) are parts of one stretch of t, and no subsequence of theirs is longer than that stretch's. So stretches are compared with s all at once; those that can't pass the best so far go, and the others are parted in four until a stretch is a window. First some of the most promising stretches have a window of theirs compared, which raises the best early.
    """
    m, n = len(s), len(t)
    words = (m + 63) // 64
    places: dict[str, int] = {}
    for i, ch in enumerate(s):
        places[ch] = places.get(ch, 0) | 1 << i
    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbol = np.zeros(n + 2 * m + 2, dtype=np.int64)  # 0: not in s, or beyond the end
    table = np.zeros((words, len(places) + 1), dtype=np.uint64)
    for k, (ch, bits) in enumerate(places.items(), 1):
        symbol[:n][codes == ord(ch)] = k
        for w in range(words):
            table[w, k] = np.uint64(bits >> 64 * w & 0xFFFFFFFFFFFFFFFF)
    full = np.array([(1 << min(64, m - 64 * w)) - 1 for w in range(words)], dtype=np.uint64)

    def common(starts: np.ndarray, length: int) -> np.ndarray:
        """Longest common subsequences of s with the stretches of one length."""
        state = np.repeat(full[:, None], len(starts), axis=1)
        for i in range(length):
            now = symbol[starts + i]
            carry = None
            for w in range(words):
                x = state[w]
                u = x & table[w][now]
                total = x + u
                if words > 1:
                    over = total < x
                    if carry is not None:
                        total = total + carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                state[w] = (total | (x - u)) & full[w]
        return m - np.bitwise_count(state).sum(axis=0).astype(np.int64)

    last = n - m  # the last window's start
    h = max(1, min(m, n // 1024))  # about a thousand stretches: fewer would hardly be faster
    starts = np.arange(0, last + 1, h)
    best, first = least, True
    while len(starts):
        bound = 100.0 * common(starts, m + h - 1) / m
        if h == 1:
            return max(best, float(bound.max()))
        if first:
            top = starts[np.argsort(-bound, kind="stable")[:64]]
            best, first = max(best, float(100.0 * common(np.minimum(top + h // 2, last), m).max() / m)), False
        starts = starts[bound > best]
        part = (h + 3) // 4
        starts = np.unique((starts[:, None] + np.arange(0, h, part)).ravel())
        starts, h = starts[starts <= last], part
    return best


#: Starts of one stretch, and characters of texts that are compared at once, in partial_ratios.
STRETCH, TOGETHER = 8, 1 << 16


class Pattern:
    """A string that is compared with many texts."""

    def __init__(self, s: str):
        self.s, self.m = s, len(s)
        self.full = np.array([(1 << min(64, self.m - lo)) - 1 for lo in range(0, self.m, 64)], dtype=np.uint64)
        self.both = self._table(s), self._table(s[::-1])

    def _table(self, s: str) -> tuple[np.ndarray, np.ndarray]:
        """The number of each character code up to the highest (0: not in s, as are those beyond), and the bits of each number in every word of 64 places."""
        places: dict[int, int] = {}
        for i, ch in enumerate(s):
            places[ord(ch)] = places.get(ord(ch), 0) | 1 << i
        number = np.zeros(max(places, default=0) + 2, dtype=np.int32)
        bits = np.zeros((len(self.full), len(places) + 1), dtype=np.uint64)
        for k, (c, at) in enumerate(places.items(), 1):
            number[c] = k
            for w in range(len(self.full)):
                bits[w, k] = np.uint64(at >> 64 * w & 0xFFFFFFFFFFFFFFFF)
        return number, bits

    def masks(self, text: np.ndarray, back: bool = False) -> np.ndarray:
        """The bits of each character code of text in every word; back: for the reversed string."""
        number, bits = self.both[back]
        return bits[:, number[np.minimum(text, len(number) - 1)]]

    def start(self, n: int) -> np.ndarray:
        return np.repeat(self.full[:, None], n, axis=1)

    def step(self, state: np.ndarray, now: list[np.ndarray]) -> None:
        """One character more: now are its bits in every word."""
        carry = None
        for w in range(len(state)):
            x = state[w]
            u = x & now[w]
            total = x + u
            if len(state) > 1:
                over = total < x
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            state[w] = (total | (x - u)) & self.full[w]

    def common(self, state: np.ndarray) -> np.ndarray:
        return self.m - np.bitwise_count(state).sum(axis=0).astype(np.int64)


def partial_ratios(s: Pattern, texts: list[str]) -> np.ndarray:
    """partial_ratio of s with each text, for many texts at once."""
    out = np.zeros(len(texts))
    part: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if not s.m or len(t) < s.m:
            out[i] = partial_ratio(s.s, t)
            continue
        part.append(i)
        size += len(t)
        if size >= TOGETHER:
            out[part] = _together(s, [texts[j] for j in part])
            part, size = [], 0
    if part:
        out[part] = _together(s, [texts[j] for j in part])
    return out


def _together(s: Pattern, texts: list[str]) -> np.ndarray:
    """As _windows, on texts that lie behind one another: all stretches of STRETCH starts, then for each text the windows of its best stretches, then those of all that may still be better."""
    m, h = s.m, STRETCH
    length = np.array([len(t) for t in texts])
    begin = np.cumsum(length) - length
    n = int(length.sum())
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    best = np.zeros(len(texts))
    ahead = s.masks(codes)
    for first, way in ((begin, 1), (begin + length - 1, -1)):
        state = s.start(len(texts))
        for i in range(m - 1):
            s.step(state, list(s.masks(codes[first + way * i], back=way < 0)))
            best = np.maximum(best, 200.0 * s.common(state) / (m + i + 1))
    stretches = -(-n // h)
    padded = np.zeros((len(ahead), stretches * h + m + h), dtype=np.uint64)
    padded[:, :n] = ahead
    state = s.start(stretches)
    for i in range(m + h - 1):
        s.step(state, [b[i : i + stretches * h : h] for b in padded])
    bound = np.repeat(100.0 * s.common(state) / m, h)[:n]
    doc = np.repeat(np.arange(len(texts)), length)
    bound[np.arange(n) - begin[doc] > (length - m)[doc]] = -1.0  # no window begins here

    def look(starts: np.ndarray) -> None:
        for lo in range(0, len(starts), TOGETHER):
            some = starts[lo : lo + TOGETHER]
            state = s.start(len(some))
            for i in range(m):
                s.step(state, [b[some + i] for b in padded])
            np.maximum.at(best, doc[some], 100.0 * s.common(state) / m)

    top = np.maximum.reduceat(bound, begin)
    looked = (bound == top[doc]) & (bound > best[doc])
    look(np.flatnonzero(looked))
    look(np.flatnonzero((bound > best[doc]) & ~looked))
    return best


#: Characters of a gram in gram_bound.
GRAM = 3


def gram_codes(t: str) -> np.ndarray:
    """A number for the gram at each place of t."""
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(c) < GRAM:
        return np.zeros(0, dtype=np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def gram_bound(m: int, n: int, s_grams: np.ndarray, t_grams: np.ndarray) -> float:
    """partial_ratio is at most this for a shorter string of m characters in one of n, from the places of t's grams that are grams of s.

    Of the m - 2 grams of s, every character left out of the common subsequence breaks 3 at most, and every one of the window that is put between breaks 2; those left stand in the window. So with g of them, L <= (g + 2 (m + 1) + 2 w) / 5 for a window of w, and 200 L / (m + w) is greatest where that meets L <= w. g is the most in any window of m.
    """
    if m < GRAM:
        return 100.0
    hits = np.concatenate(([0], np.cumsum(np.isin(t_grams, s_grams))))
    span = m - GRAM + 1
    g = int((hits[span:] - hits[:-span]).max()) if len(hits) > span else int(hits[-1])
    g = min(g, span)
    w = min(float(m), (g + 2 * (m + 1)) / 3)
    return min(100.0, max(200.0 * w / (m + w), 200.0 * min(m, (g + 4 * m + 2) / 5) / (2 * m)) + 1e-9)


def _pairwise(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def pair_ratio():
    """ratio as a UDF of two columns, for expressions and for SQL."""
    return _pairwise(ratio)


def pair_partial():
    """partial_ratio of the lower-cased strings, from 0 to 1, likewise."""
    return _pairwise(lambda x, y: partial_ratio(x.lower(), y.lower()) / 100)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    return pair_ratio()(a, b)


def fuzzy_partial(a: Column, b: Column) -> Column:
    """partial_ratio of the lower-cased strings, from 0 to 1."""
    return pair_partial()(a, b)
