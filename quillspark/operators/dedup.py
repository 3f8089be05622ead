"""Exact and near duplicates, online decisions and index maintenance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fuzzy import gram_codes
from ..functions.text import content_hash, shingles, strip
from ..sources.scratch import checkpoint, stored
from . import gram_sets
from .fusion import top_per_query
from .lexical import few_or_merge

PERMUTATIONS = 128
#: Pairs at the very threshold that may share no band.
MISSED = 0.04


def banding(threshold: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows) for a threshold: as many rows a band as can be, so that unlike documents meet least, while at most MISSED of the pairs whose signatures agree in just a share `threshold` of their places share no band; of those that agree in more, fewer are missed."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    rows = max((r for r in range(1, permutations + 1) if (1 - threshold**r) ** (permutations // r) <= MISSED), default=1)
    return permutations // rows, rows


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(content_hash, copies, canonical_doc_id) of contents that occur more than once."""
    return docs.select(content_hash(F.col("text")).alias("content_hash"), "doc_id").groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("canonical_doc_id")).where("copies > 1")


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, signature): MinHash of the distinct character trigrams, with fixed permutations; without shingles null."""
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 31, permutations, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 31, permutations, dtype=np.uint64)

    @F.pandas_udf("array<long>")
    def sign(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            if x is None or not len(x):
                out.append(None)
                continue
            h = np.asarray(x, dtype=np.int64).view(np.uint64)
            best = np.full(permutations, np.iinfo(np.uint64).max, dtype=np.uint64)
            for lo in range(0, len(h), 4096):
                best = np.minimum(best, ((h[lo : lo + 4096, None] * a + b) >> np.uint64(16)).min(axis=0))
            out.append(best.astype(np.int64))
        return pd.Series(out)

    grams = F.transform(shingles(F.col("text")), lambda g: F.xxhash64(g))
    return docs.select("doc_id", sign(grams).alias("signature"))


def estimate(a: F.Column, b: F.Column) -> F.Column:
    """Share of equal places of two signatures of one length."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), same / F.size(a)).otherwise(F.raise_error(F.lit("signatures differ in length")))


def band_rows(signed: DataFrame, threshold: float = 0.9) -> DataFrame:
    bands, rows = banding(threshold)
    cuts = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.slice("signature", i * rows + 1, rows)).alias("h")))
    return signed.where("signature is not null").select("doc_id", "signature", F.explode(cuts).alias("x")).select("doc_id", "signature", "x.band", "x.h")


#: Rows of one side of a block of a bucket, and rows that are compared at once in it.
BLOCK, TILE = 4096, 512


def _packed(signed: DataFrame) -> DataFrame:
    """(id, signature, sig) of distinct signatures and their least doc_id; sig: the signature's bytes."""

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, dtype="<i8").tobytes() for x in s])

    return signed.where("signature is not null").groupBy("signature").agg(F.min("doc_id").alias("id")).select("id", "signature", pack("signature").alias("sig"))


def like(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """(a, b, similarity) of ids of left and right (distinct signatures, see _packed) that share a band and whose signatures agree in a share of at least threshold; right None: left with itself, a > b.

    A bucket is cut into pairs of blocks of BLOCK rows, which are compared in tasks: first a byte of each place, then the places themselves of what is left. A pair is told in the first band that it shares, so pairs are never brought together to be counted once.
    """
    bands, rows = banding(threshold)
    key = ["band", "h"]

    def cut(x: DataFrame) -> DataFrame:
        hashes = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.slice("signature", i * rows + 1, rows)).alias("h")))
        return x.select("id", F.explode(hashes).alias("x")).select("id", "x.band", "x.h")

    def shared(x: DataFrame) -> DataFrame:
        """Rows of buckets where others may be, by ids; signatures come to these alone."""
        return cut(x).join(n, key).join(x.select("id", "sig"), "id")

    x = cut(left)
    n = x.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    if right is None:
        n = n.where("n > 1").select(*key, "n", F.col("n").alias("m"))
    else:
        n = n.join(cut(right).groupBy(*key).agg(F.count(F.lit(1)).alias("m")), key)
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    n = n.select(*key, parts("n").alias("n"), parts("m").alias("m"))
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    x = shared(left).withColumn("part", part("n"))
    if right is None:
        x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(*key, F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), (F.col("part") <= F.col("o")).alias("first"), (F.col("part") >= F.col("o")).alias("second"), "id", "sig")
    else:
        y = shared(right).select(*key, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), part("m").alias("j"), F.lit(False).alias("first"), F.lit(True).alias("second"), "id", "sig")
        x = x.select(*key, "part", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), F.lit(True).alias("first"), F.lit(False).alias("second"), "id", "sig").withColumnRenamed("part", "i").unionByName(y)
    alone = right is None

    def meet(t: pa.Table) -> pa.Table:
        ids, band = t["id"].to_numpy(), t["band"][0].as_py()
        raw = t["sig"].to_pylist()
        sig = np.frombuffer(b"".join(raw), dtype="<i8").reshape(len(raw), -1)
        p, q = (np.flatnonzero(t[c].to_numpy(zero_copy_only=False)) for c in ("first", "second"))
        across = t["i"][0].as_py() != t["j"][0].as_py()
        byte = np.ascontiguousarray((sig & 255).astype(np.uint8).T)
        least = max(1, int(np.ceil(threshold * len(byte) - 1e-9)))
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        for lo in range(0, len(p), TILE):
            for at in range(0, len(q), TILE):
                g, h = p[lo : lo + TILE], q[at : at + TILE]
                same = np.zeros((len(g), len(h)), dtype=np.uint8 if len(byte) < 256 else np.uint16)
                left, over = byte[:, g], byte[:, h]
                for k in range(len(byte)):
                    same += left[k][:, None] == over[k]
                i, j = np.nonzero(same >= least)
                if alone:
                    up = (ids[g[i]] > ids[h[j]]) | across
                    i, j = i[up], j[up]
                for some in range(0, len(i), 1 << 14):
                    u, v = g[i[some : some + (1 << 14)]], h[j[some : some + (1 << 14)]]
                    eq = sig[u] == sig[v]
                    share = eq.sum(axis=1) / eq.shape[1]
                    shared = np.stack([eq[:, k * rows : (k + 1) * rows].all(axis=1) for k in range(bands)], axis=1)
                    good = (share >= threshold) & (shared.argmax(axis=1) == band)
                    u, v = ids[u[good]], ids[v[good]]
                    out.append((np.maximum(u, v), np.minimum(u, v), share[good]) if alone else (u, v, share[good]))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"a": a, "b": b, "similarity": s})

    return x.groupBy(*key, "i", "j").applyInArrow(meet, "a long, b long, similarity double")


def lookup(signed: DataFrame, index: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(doc_id, match_id, similarity) of candidates that share a band with estimate at or over threshold. Distinct signatures are compared, and copies of either side are told of their matches afterwards."""
    own = _packed(signed)
    if signed is index:
        half = stored(like(own, None, threshold), "like")
        pairs = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(own.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
    else:
        pairs = like(own, _packed(index), threshold)
    # Copies of a signature, by 128 bits of it.
    bits = [F.xxhash64("signature").alias("k1"), F.xxhash64(F.lit(1), "signature").alias("k2")]
    members = signed.where("signature is not null").select("doc_id", *bits).join(own.select("id", *bits), ["k1", "k2"]).select("doc_id", F.col("id").alias("a"))
    return members.join(pairs, "a").where("doc_id <> b").select("doc_id", F.col("b").alias("match_id"), "similarity")


def verified(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(doc_id, match_id, similarity): for each document its least earlier one with a Jaccard similarity of the trigram sets of at least threshold, copies of a content left out but for the first.

    The sets themselves meet, in groups of near sizes (see gram_sets), so no pair is missed and no candidate is kept between steps.
    """
    return gram_sets.earlier(docs, threshold)


#: Texts, and characters of them, of one side of a block of candidates.
TEXTS, CHARACTERS = 512, 4 << 20


def above(docs: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, match_id, similarity) of pairs met (doc_id, match_id) of unlike contents whose trigram sets have a Jaccard similarity of at least threshold, the one with the least match_id of each doc_id among them.

    Documents are dealt into blocks by their least partner, several for a partner of many, and a text goes once to every two blocks that have a pair of it, not once to each of its pairs. Sets are made there, as sorted numbers.
    """
    ends = met.unionByName(met.select(F.col("match_id").alias("doc_id"), F.col("doc_id").alias("match_id"))).groupBy("doc_id").agg(F.least(F.min("match_id"), F.first("doc_id")).alias("root"))
    texts = docs.select("doc_id", strip(F.lower(F.coalesce("text", F.lit("")))).alias("t")).join(few_or_merge(ends.select("doc_id")), "doc_id", "left_semi")
    texts = stored(texts.join(ends, "doc_id"), "candidate-texts")
    shares = texts.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TEXTS, F.sum(F.length("t")) / CHARACTERS)).alias("shares"))
    dealt = stored(texts.select("doc_id", "root").join(shares, "root").select("doc_id", "root", F.pmod(F.xxhash64("doc_id"), F.col("shares")).alias("share")), "candidate-blocks")
    key = ["r", "p", "q", "o"]
    left, right = dealt.toDF("doc_id", "r", "p"), dealt.toDF("match_id", "q", "o")
    pairs = stored(met.join(left, "doc_id").join(right, "match_id").select(*key, "doc_id", "match_id"), "candidate-pairs")
    need = pairs.select(*key, F.explode(F.array("doc_id", "match_id")).alias("doc_id")).distinct().toDF(*(f"{k}_" for k in key), "doc_id")
    sent = need.join(texts.select("doc_id", "t"), "doc_id")

    def compare(asked: pa.Table, rows: pa.Table) -> pa.Table:
        text = dict(zip(rows["doc_id"].to_pylist(), rows["t"].to_pylist(), strict=True))
        sets: dict[int, np.ndarray] = {}
        out = []
        found = None
        for a, b in sorted(zip(asked["doc_id"].to_pylist(), asked["match_id"].to_pylist(), strict=True)):
            if a == found:
                continue
            for x in (a, b):
                if x not in sets:
                    sets[x] = np.unique(gram_codes(text[x]))
            m, n = len(sets[a]), len(sets[b])
            if not m or not n or min(m, n) < threshold * max(m, n) - 1e-6:  # without a gram: its own shingle, unlike all others
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if common / (m + n - common) >= threshold:
                out.append((a, b, common / (m + n - common)))
                found = a
        a, b, j = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"doc_id": pa.array(a, pa.int64()), "match_id": pa.array(b, pa.int64()), "similarity": pa.array(j, pa.float64())})

    return pairs.groupBy(*key).cogroup(sent.groupBy(*(f"{k}_" for k in key))).applyInArrow(compare, "doc_id long, match_id long, similarity double")


def duplicate_list(docs: DataFrame, threshold: float = 0.9, most: int = 5) -> DataFrame:
    """For each document up to `most` matches, copies of itself included, best first."""
    s = checkpoint(fingerprints(docs))
    signed = s.where("signature is not null")
    order = W.partitionBy("signature").orderBy("doc_id")
    members = signed.withColumn("r", F.row_number().over(order)).withColumn("first", F.min("doc_id").over(order)).where(F.col("r") <= most + 1).select("first", F.col("doc_id").alias("match_id"))
    own = signed.groupBy("signature").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.col("doc_id").alias("first"), F.lit(1.0).alias("similarity"))
    near = lookup(s, s, threshold).withColumnRenamed("match_id", "first").unionByName(own)
    every = near.join(members, "first").where("doc_id <> match_id").select("doc_id", "match_id", F.col("similarity").alias("score"))
    return top_per_query(every, most, key="doc_id", item="match_id").withColumnRenamed("score", "similarity")


def add(index: DataFrame, signed: DataFrame) -> DataFrame:
    return remove(index, signed.select("doc_id")).unionByName(signed)


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("doc_id"), "doc_id", "left_anti")


def clear(index: DataFrame) -> DataFrame:
    return index.limit(0)


def size(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("size"))


def _dropped(pairs: DataFrame) -> DataFrame:
    """(doc_id) of the documents that go if each in id order goes when an earlier kept one matches it; pairs: (doc_id, match_id), match_id less.

    In each round, matches without an open match of their own are kept, and what they match goes.
    """
    edges = checkpoint(pairs.select("doc_id", "match_id"))
    out = edges.select("doc_id").limit(0)
    while edges.take(1):
        sure = edges.select("match_id").distinct().join(edges.select(F.col("doc_id").alias("match_id")).distinct(), "match_id", "left_anti")
        gone = edges.join(sure, "match_id", "left_semi").select("doc_id").distinct().checkpoint()
        edges = edges.join(gone, "doc_id", "left_anti").join(gone.select(F.col("doc_id").alias("match_id")), "match_id", "left_anti").checkpoint()
        out = out.unionByName(gone)
    return out


def handle(docs: DataFrame, action: str = "flag", threshold: float = 0.9) -> DataFrame:
    """Decision on each document in id order: doc_id, kept, canonical_doc_id, metadata.

    flag keeps all and points at the best earlier match; skip and merge drop those with an earlier kept match (a dropped document is no match for later ones) and point at the best of these, merge adds their metadata to the match's (its own values win). docs: doc_id, text and, for merge, metadata map.
    """
    if action not in ("flag", "skip", "merge"):
        raise ValueError(f"unknown action {action!r}")
    s = checkpoint(fingerprints(docs))
    # Of equal signatures the first document alone can be kept, so matches are looked up among these.
    earlier = lookup(s, s, threshold).where("match_id < doc_id")
    if action != "flag":
        earlier = earlier.join(_dropped(earlier).select(F.col("doc_id").alias("match_id")), "match_id", "left_anti")
    first = top_per_query(earlier.withColumnRenamed("similarity", "score"), 1, key="doc_id", item="match_id").select("doc_id", F.col("match_id").alias("canonical_doc_id"))
    out = docs.join(first, "doc_id", "left")
    kept = F.lit(True) if action == "flag" else F.col("canonical_doc_id").isNull()
    has = "metadata" in docs.columns
    meta = F.col("metadata") if has else F.create_map().cast("map<string,string>")
    out = out.select("doc_id", kept.alias("kept"), "canonical_doc_id", meta.alias("metadata"))
    if action != "merge" or not has:
        return out
    given = out.where("canonical_doc_id is not null").select(F.col("canonical_doc_id").alias("doc_id"), F.explode("metadata").alias("key", "value")).groupBy("doc_id", "key").agg(F.min("value").alias("value")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("given"))
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return out.join(given, "doc_id", "left").select("doc_id", "kept", "canonical_doc_id", F.when(F.col("given").isNull(), own).otherwise(F.map_concat(F.map_filter("given", lambda k, _: ~F.map_contains_key(own, k)), own)).alias("metadata"))


def mark(corpus: DataFrame, decisions: DataFrame) -> DataFrame:
    """corpus with is_duplicate and canonical_doc_id from (doc_id, canonical_doc_id) rows."""
    rest = corpus.drop("is_duplicate", "canonical_doc_id")
    return rest.join(decisions.select("doc_id", "canonical_doc_id"), "doc_id", "left").withColumn("is_duplicate", F.col("canonical_doc_id").isNotNull())
