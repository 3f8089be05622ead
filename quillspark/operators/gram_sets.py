"""Earlier documents with nearly the same trigrams, on the sets themselves and without signatures.

A set is kept as bits: one for each of the WORDS most frequent trigrams of a sample, and FOLDED more that the others are hashed to, whose numbers follow. Sets over a similarity differ little in size and in bits, and their bits lie near each other along any directions; so most pairs are ruled out by a product of matrices, the rest by their bits, and what is left is decided by the sets. The sample decides how many pairs are ruled out by what, never which pairs are found.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import gram_codes
from ..functions.text import strip
from ..sources.scratch import stored

#: Trigrams with a bit of their own, and bits for all others.
WORDS, FOLDED = 4096, 1024
#: Documents that the trigrams are chosen by, characters read of each, documents that the directions are fitted on, and directions.
SAMPLE, HEAD, FITTED, DIRECTIONS = 2048, 1 << 15, 2048, 512
#: Sets, and bytes of them, of one share of a group of sizes.
SETS, BYTES = 32768, 16 << 20
#: Rows of either side of a product, pairs whose bits are compared at once, numbers that are sorted at once.
ROWS, PAIRS, NUMBERS = 4096, 1 << 14, 1 << 22


def grams(t: str) -> np.ndarray:
    """The distinct trigrams of t, as sorted numbers."""
    return np.unique(gram_codes(t))


def split(codes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits as bytes, numbers of the trigrams without a bit of their own)."""
    flags = np.zeros(WORDS + FOLDED, dtype=bool)
    at = np.searchsorted(words, codes)
    known = np.zeros(len(codes), dtype=bool)
    if len(words):
        known = words[np.minimum(at, len(words) - 1)] == codes
    flags[at[known]] = True
    rest = codes[~known]
    mixed = rest.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    flags[WORDS + ((mixed >> np.uint64(40)) % np.uint64(FOLDED)).astype(np.int64)] = True
    return np.packbits(flags), rest


def fit(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigrams with a bit of their own, mean of the bits, directions along which they differ most) of a sample."""
    sets = [grams(t) for t in texts]
    codes, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *sets]), return_counts=True)
    words = np.sort(codes[np.argsort(-n, kind="stable")[:WORDS]])
    sets = [s for s in sets if len(s)][:FITTED]
    if len(sets) < 2:
        return words, np.zeros(WORDS + FOLDED, dtype=np.float32), np.zeros((WORDS + FOLDED, 0), dtype=np.float32)
    x = np.unpackbits(np.stack([split(s, words)[0] for s in sets]), axis=1).astype(np.float32)
    mean = x.mean(axis=0)
    x -= mean
    _, v = np.linalg.eigh(x @ x.T)
    directions, _ = np.linalg.qr((x.T @ v[:, ::-1][:, :DIRECTIONS]).astype(np.float64))
    return words, mean, np.ascontiguousarray(directions.astype(np.float32))


class Block:
    """Sets of one block, in the order of their ids, and for each the least earlier one found so far."""

    def __init__(self, t: pa.Table, mean: np.ndarray, directions: np.ndarray, threshold: float):
        t = t.sort_by("doc_id")
        self.ids, self.n = t["doc_id"].to_numpy(), t["n"].to_numpy().astype(np.int64)
        self.share, self.home = t["share"].to_numpy(), t["home"].to_numpy(zero_copy_only=False)
        wide, self.bits, rest = (WORDS + FOLDED) // 8, np.empty((len(t), (WORDS + FOLDED) // 64), dtype=np.uint64), []
        for k, x in enumerate(x for c in t["packed"].chunks for x in c):
            raw = zlib.decompress(x.as_buffer())
            self.bits[k] = np.frombuffer(raw, dtype=np.uint64, count=wide // 8)
            rest.append(np.frombuffer(raw, dtype=np.int64, offset=wide))
        self.size = np.array([len(x) for x in rest], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.names, self.rest = np.unique(np.concatenate(rest), return_inverse=True)
        # A pair passes if the product of its points, the last two columns of one changed about, is not below 0: half of what the limit leaves over the squared distance.
        self.threshold, self.part = threshold, (1 - threshold) / (1 + threshold)
        k = directions.shape[1]
        self.points, self.about = np.empty((len(t), k + 2), dtype=np.float32), [*range(k), k + 1, k]
        for lo in range(0, len(t), 1024):
            y = np.unpackbits(self.bits[lo : lo + 1024].view(np.uint8), axis=1).astype(np.float32)
            self.points[lo : lo + 1024, :k] = (y - mean) @ directions
        half = (np.einsum("ij,ij->i", self.points[:, :k], self.points[:, :k], dtype=np.float64) - self.part * self.n) / 2
        self.points[:, k], self.points[:, k + 1] = -half, 1
        self.slack = -0.25 - 1e-5 * np.abs(half).max(initial=0)  # of single precision
        self.best, self.similarity = np.full(len(t), len(t)), np.zeros(len(t))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Trigrams that the sets of pairs have in common."""
        words = WORDS // 64
        out = np.bitwise_count(self.bits[a, :words] & self.bits[b, :words]).sum(axis=1, dtype=np.int64)
        both = np.flatnonzero((self.size[a] > 0) & (self.size[b] > 0))
        part = np.cumsum(self.size[a[both]] + self.size[b[both]]) // NUMBERS
        for some in np.split(both, np.flatnonzero(np.diff(part)) + 1):
            keys = []
            for x in (a[some], b[some]):
                n = self.size[x]
                at = np.arange(n.sum()) + np.repeat(self.start[x] - (np.cumsum(n) - n), n)
                keys.append(np.repeat(np.arange(len(x)), n) * len(self.names) + self.rest[at])
            keys = np.sort(np.concatenate(keys))
            out[some] += np.bincount(keys[1:][keys[1:] == keys[:-1]] // max(1, len(self.names)), minlength=len(some))
        return out

    def decide(self, a: np.ndarray, b: np.ndarray) -> None:
        """Takes those of pairs (b earlier) that are alike enough; a's best so far are later than b or none."""
        m, n = self.n[a], self.n[b]
        ok = np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64) <= self.part * (m + n) + 1e-6
        a, b, m, n = a[ok], b[ok], m[ok], n[ok]
        common = self.common(a, b)
        similarity = common / (m + n - common)
        ok = similarity >= self.threshold
        order = np.flatnonzero(ok)[np.lexsort((-b[ok], a[ok]))]
        order = order[b[order] < self.best[a[order]]]
        self.best[a[order]], self.similarity[a[order]] = b[order], similarity[order]  # of several the last, the least b

    def look(self, a: np.ndarray, b: np.ndarray) -> None:
        """The least earlier one among b for each of a, in portions of b that grow, as those who have found one look no further."""
        lo, step = 0, 64
        while lo < len(b):
            tile = b[lo : lo + step]
            lo, step = lo + step, min(2 * step, ROWS // 4)
            other = self.points[tile][:, self.about].T
            a = a[(a > tile[0]) & (self.best[a] > tile[0])]
            for at in range(0, len(a), ROWS):
                x = a[at : at + ROWS]
                i, j = np.nonzero(self.points[x] @ other >= self.slack)
                u, v = x[i], tile[j]
                m, n = self.n[u], self.n[v]
                ok = (u > v) & (np.minimum(m, n) >= self.threshold * np.maximum(m, n) - 1e-6)
                u, v = u[ok], v[ok]
                for k in range(0, len(u), PAIRS):
                    self.decide(u[k : k + PAIRS], v[k : k + PAIRS])

    def found(self, i: int, j: int) -> pa.Table:
        """Pairs of shares i and j; those of two sets of the lesser size are looked at in their own group."""
        for one, other in {(i, j), (j, i)}:
            own, others = self.share == one, self.share == other
            self.look(np.flatnonzero(own & self.home), np.flatnonzero(others))
            self.look(np.flatnonzero(own & ~self.home), np.flatnonzero(others & self.home))
        a = np.flatnonzero(self.best < len(self.ids))
        return pa.table({"doc_id": self.ids[a], "match_id": self.ids[self.best[a]], "similarity": self.similarity[a]})


def earlier(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, match_id, similarity): for each document its least earlier one with a Jaccard similarity of the trigram sets of at least threshold, copies of a content left out but for the first.

    Sets are dealt into groups by size, each with the sets of the next lesser sizes, and large groups into shares of SETS; every two shares of a group meet in a task, so a set is sent as many times as its two groups have shares. Every pair of sizes that can match is looked at, so time grows with the square of the rows; only results leave a task.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), strip(F.lower(F.coalesce("text", F.lit("")))).alias("t"))
    every = max(1, docs.count() // SAMPLE)
    few = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.substring("t", 1, HEAD)).limit(2 * SAMPLE)
    words, mean, directions = fit([r[0] for r in few.collect()])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, t in zip(batch["doc_id"].to_pylist(), batch["t"], strict=True):
                t = t.as_py()
                codes = grams(t)
                if len(codes):  # without a trigram: its own shingle, unlike all others
                    bits, rest = split(codes, words)
                    out.append((i, hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest(), len(codes), zlib.compress(bits.tobytes() + rest.tobytes(), 1)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "hash", "n", "packed"])

    packed = texts.mapInArrow(pack, "doc_id long, hash binary, n int, packed binary")
    first = packed.groupBy("hash").agg(F.min_by(F.struct("doc_id", "n", "packed"), "doc_id").alias("x")).select("x.*")
    # A set at the limit of size is one group further down at most; the least part of a group is for rounding.
    cell = F.floor(F.log(F.col("n")) / max(-math.log(threshold), 0.01) + 1e-9).cast("int")
    sets = stored(first.withColumn("cell", cell), "gram-sets")
    sizes = {r["cell"]: (r["n"], r["b"]) for r in sets.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("packed")).alias("b")).collect()}
    shares = {}
    for c in sizes:
        n, b = (sum(x) for x in zip(sizes[c], sizes.get(c - 1, (0, 0)), strict=True))
        shares[c] = max(1, math.ceil(n / SETS), math.ceil(b / BYTES))
    if not shares:
        return docs.sparkSession.createDataFrame([], "doc_id long, match_id long, similarity double")
    of = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))
    met = sets.select("*", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("c")).withColumn("shares", F.try_element_at(of, "c")).where("shares is not null")
    met = met.withColumn("share", F.pmod(F.xxhash64("doc_id"), "shares").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    met = met.select("c", F.least("share", "o").alias("i"), F.greatest("share", "o").alias("j"), "share", (F.col("cell") == F.col("c")).alias("home"), "doc_id", "n", "packed")

    def meet(t: pa.Table) -> pa.Table:
        return Block(t, mean, directions, threshold).found(t["i"][0].as_py(), t["j"][0].as_py())

    pairs = met.groupBy("c", "i", "j").applyInArrow(meet, "doc_id long, match_id long, similarity double")
    return pairs.groupBy("doc_id").agg(F.min(F.struct("match_id", "similarity")).alias("x")).select("doc_id", "x.match_id", "x.similarity")
