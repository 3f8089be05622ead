"""Vectorised word splitting and hashing on UTF-8 bytes.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased, as in the contracts.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], dtype=np.uint64))[0])


_TABLE: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0.. and their inverses modulo 2^64, at least n of each; the tables grow by doubling and stay."""
    if len(_TABLE[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            a = np.ones(size, dtype=np.uint64)
            have, step = 1, base
            while have < size:
                m = min(have, size - have)
                a[have : have + m] = a[:m] * np.uint64(step)
                step = step * step & _MASK
                have += m
            _TABLE[i] = a
    return _TABLE[0], _TABLE[1]


#: Bytes that end a word: the spaces of the contracts, or all ASCII but letters, digits and the underscore.
_SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
_SIGNS = np.array([b < 128 and not (chr(b).isalnum() or chr(b) == "_") for b in range(256)])


def hash_words(texts: list[str], keep_case: bool = False, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, words before each text and in all, first byte and end of each word in buf, buf).

    buf holds the texts' UTF-8 bytes, each followed by one newline. With letters_only, all ASCII bytes but letters, digits and underscores end words too; bytes of other characters are part of words.
    """
    raw = ("\n".join(texts) + "\n").encode("utf-8", "surrogatepass")
    buf = np.frombuffer(raw, dtype=np.uint8)
    if not keep_case:
        upper = (buf >= 65) & (buf <= 90)
        buf = buf + (upper.view(np.uint8) << 5)
    space = (_SIGNS if letters_only else _SPACES)[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    pw, inv = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inv[starts]
    h = mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))
    sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 if not t.isascii() else len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    first = np.searchsorted(starts, bounds)
    return h, first, starts, ends, buf


def shingle(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width words from each word on; the last width - 1 ones reach past the end of h and are 0."""
    n = len(h) - width + 1
    out = np.zeros(len(h), dtype=np.uint64)
    if n <= 0:
        return out
    acc = h[:n].copy()
    for k in range(1, width):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n])
    out[:n] = acc
    return out
