"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, text_batches

SCHEMA = "doc_id long, items array<long>, coverages array<double>"
WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of width tokens."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    v = ids.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        if width <= 16:
            for k in range(width):
                h = h * _BASE + v[k : k + n]
        else:
            power = np.uint64(pow(int(_BASE), width, 1 << 64))
            inner, acc = v.tolist(), 0
            base, mask, pw = int(_BASE), (1 << 64) - 1, int(power)
            out = []
            for i, x in enumerate(inner):
                acc = (acc * base + x - (inner[i - width] * pw if i >= width else 0)) & mask
                if i >= width - 1:
                    out.append(acc)
            h = np.array(out, dtype=np.uint64)
    return h


def free_windows(marked: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows without a marked token."""
    c = np.concatenate(([0], np.cumsum(marked)))
    n = len(marked) - width + 1
    return np.flatnonzero(c[width:] == c[:n]) if n > 0 else np.zeros(0, dtype=np.int64)


def matches(item: np.ndarray, doc: np.ndarray, item_marked: np.ndarray, doc_marked: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(length, item start, doc start) of the maximal unmarked common runs of at least width tokens."""
    p, q = free_windows(item_marked, width), free_windows(doc_marked, width)
    if not len(p) or not len(q):
        return []
    hp, hq = window_hashes(item, width)[p], window_hashes(doc, width)[q]
    order = np.argsort(hq, kind="stable")
    hs = hq[order]
    lo, hi = np.searchsorted(hs, hp, "left"), np.searchsorted(hs, hp, "right")
    n = hi - lo
    if not n.sum():
        return []
    a = np.repeat(p, n)
    b = q[order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]]
    same = np.all(item[a[:, None] + np.arange(width)] == doc[b[:, None] + np.arange(width)], axis=1) if len(a) * width < 4_000_000 else np.array([np.array_equal(item[x : x + width], doc[y : y + width]) for x, y in zip(a, b, strict=True)])
    a, b = a[same], b[same]
    by_diagonal = np.lexsort((a, b - a))
    a, b = a[by_diagonal], b[by_diagonal]
    new = np.concatenate(([True], (b[1:] - a[1:] != b[:-1] - a[:-1]) | (a[1:] != a[:-1] + 1)))
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(a)]))) + width - 1
    return list(zip(size.tolist(), a[first].tolist(), b[first].tolist(), strict=True))


def tiles(item: np.ndarray, doc: np.ndarray, least: int = 5) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, doc start, length), longest first, no token in two tiles; ties by item, then doc position.

    Search lengths fall by halves to least; at each, matches are marked longest first until none is left.
    """
    item_marked, doc_marked = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool)
    out: list[tuple[int, int, int]] = []
    width = max(least, len(item))
    while True:
        while found := matches(item, doc, item_marked, doc_marked, width):
            most = max(found)[0]
            for size, p, q in sorted(m for m in found if m[0] == most):
                if not item_marked[p : p + size].any() and not doc_marked[q : q + size].any():
                    item_marked[p : p + size] = True
                    doc_marked[q : q + size] = True
                    out.append((p, q, size))
        if width == least:
            return out
        width = max(least, width // 2)


class SeedIndex:
    """Benchmark items as token ids, with the items of every run of `least` tokens."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least = least
        self.vocab: dict[str, int] = {}
        self.items: dict[int, np.ndarray] = {}
        seeds: dict[int, list[int]] = defaultdict(list)
        for key, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words(text)], dtype=np.int64)
            if not len(ids):
                continue
            self.items[key] = ids
            for h in set(window_hashes(ids, min(least, len(ids))).tolist()) if len(ids) >= least else ():
                seeds[h].append(key)
        self.hashes = np.array(sorted(seeds), dtype=np.uint64)
        self.owners = [seeds[h] for h in self.hashes.tolist()]

    def coverage(self, text: str) -> dict[int, float]:
        """Share of each item's tokens that tiles of the text cover, for items with a common seed."""
        get = self.vocab.get
        doc = np.fromiter([get(w, -1) for w in words(text)], dtype=np.int64)
        least = self.least
        if len(doc) < least or not len(self.hashes):
            return {}
        ok = free_windows(doc < 0, least)
        if not len(ok):
            return {}
        h = window_hashes(doc, least)[ok]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        if not hit.any():
            return {}
        near: dict[int, list[int]] = defaultdict(list)
        for place, k in zip(ok[hit].tolist(), at[hit].tolist(), strict=True):
            for key in self.owners[k]:
                near[key].append(place)
        out = {}
        for key, places in near.items():
            # Only tokens in a seed of this item can be in a tile; runs stay apart through a separator.
            keep = np.zeros(len(doc), dtype=bool)
            for d in range(least):
                keep[np.array(places) + d] = True
            at_ = np.flatnonzero(keep)
            gap = np.flatnonzero(np.diff(at_) > 1) + 1
            runs = np.insert(doc[at_], gap, -2)
            item = self.items[key]
            out[key] = sum(t[2] for t in tiles(item, runs, least)) / len(item)
        return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.8, broadcast_words: int = 2_000_000) -> DataFrame:
    """For each document the benchmark items covered to threshold or more by tiles of at least `least` words, reordered passages included.

    Returns doc_id, n_items (items at or over the threshold), max_coverage (0 without common seeds), best_item (least id among the best; null if none), items (sorted), contaminated.
    Words are lower-cased runs of letters, digits and underscores. Null or empty texts and items match nothing; items shorter than `least` words match nothing; items with a null id are left out and, of items with one id, the longest text (then the greatest) counts. Repeated documents keep their rows; an empty table gives no rows; other columns are not looked at.
    A benchmark of at most broadcast_words words goes to every task; a larger one is joined on seeds instead.
    """
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    b = _items(benchmark)
    size = b.agg(F.sum(F.length("text") / 2 + 1).alias("n")).collect()[0]["n"] or 0
    raw = _broadcast(d, b, least) if size <= broadcast_words else _joined(d, b, least)
    pairs = F.arrays_zip("items", "coverages")
    best = F.array_max("coverages")
    over = F.filter(pairs, lambda p: p["coverages"] >= threshold)
    return raw.select(
        "doc_id",
        F.size(over).cast("long").alias("n_items"),
        F.coalesce(best, F.lit(0.0)).alias("max_coverage"),
        F.when(F.size("items") > 0, F.array_min(F.transform(F.filter(pairs, lambda p: p["coverages"] == best), lambda p: p["items"]))).alias("best_item"),
        F.array_sort(F.transform(over, lambda p: p["items"])).alias("items"),
        (F.size(over) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.8, broadcast_words: int = 2_000_000) -> DataFrame:
    """The rows of docs, all columns, whose text covers no benchmark item to threshold or more.

    Rows are judged by their text alone (null: empty, which stays): null or shared ids, repeated rows and other columns, whatever their names, don't matter; an empty table gives an empty result.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    b = _items(benchmark)
    if (b.agg(F.sum(F.length("text") / 2 + 1).alias("n")).collect()[0]["n"] or 0) > broadcast_words:
        key = fresh(docs, "contaminated_text")
        texts = docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text"))
        bad = decontaminate(texts, benchmark, least, threshold, broadcast_words).where("contaminated").select(F.col("doc_id").alias(key)).distinct()
        return docs.join(bad, F.xxhash64(text) == F.col(key), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(SeedIndex(sorted((r["item_id"], r["text"]) for r in b.collect()), least))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = [max(shared.value.coverage(t or "").values(), default=0.0) < threshold for t in x.column(at).to_pylist()]
            yield x.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text), one row an id: the longest text, then the greatest."""
    text = F.coalesce(benchmark["text"].cast("string"), F.lit(""))
    return benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), text.alias("text")).where("item_id is not null").groupBy("item_id").agg(F.max(F.struct(F.length("text").alias("n"), "text"))["text"].alias("text"))


def _broadcast(d: DataFrame, b: DataFrame, least: int) -> DataFrame:
    index = SeedIndex(sorted((r["item_id"], r["text"]) for r in b.collect()), least)
    shared = d.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for keys, texts in text_batches(batches):
            found = [sorted(ix.coverage(t).items()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int64())), pa.array([[c for _, c in f] for f in found], pa.list_(pa.float64()))], ["doc_id", "items", "coverages"])

    return d.mapInArrow(run, SCHEMA)


def _joined(d: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """The same by an equi-join on seed hashes; candidates carry ids, texts join afterwards."""
    from .words import mix_int

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches, 1 << 20):
            out_k, out_h = [], []
            for k, t in zip(keys, texts, strict=True):
                w = words(t)
                h = {mix_int(hash_tuple(w[i : i + least])) - (1 << 63) for i in range(len(w) - least + 1)}
                out_k += [k] * len(h)
                out_h += h
            yield pa.RecordBatch.from_arrays([pa.array(out_k, pa.int64()), pa.array(out_h, pa.int64())], ["id", "seed"])

    spark = d.sparkSession
    rows = stored(d.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
    ds = rows.select("row", "text").mapInArrow(seeds, "id long, seed long").withColumnRenamed("id", "row")
    bs = b.select("item_id", "text").mapInArrow(seeds, "id long, seed long").withColumnRenamed("id", "item_id")
    cand = ds.join(bs, "seed").select("row", "item_id").distinct()
    both = cand.join(rows, "row").join(b.withColumnRenamed("text", "item_text"), "item_id").select("row", "text", "item_id", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rid, texts, items, item_texts = (x.column(i).to_pylist() for i in range(4))
            cov = [SeedIndex([(i, it)], least).coverage(t or "").get(i) for t, i, it in zip(texts, items, item_texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(items, pa.int64()), pa.array(cov, pa.float64())], ["row", "item_id", "coverage"])

    scored = both.mapInArrow(run, "row long, item_id long, coverage double").where("coverage is not null")
    lists = scored.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("item_id", "coverage"))).alias("x"))
    empty = F.array().cast("array<struct<item_id:bigint,coverage:double>>")
    out = rows.select("row", "doc_id").join(lists, "row", "left").withColumn("x", F.coalesce("x", empty))
    assert spark is out.sparkSession
    return out.select("doc_id", F.transform("x", lambda s: s["item_id"]).alias("items"), F.transform("x", lambda s: s["coverage"]).alias("coverages"))


def hash_tuple(tokens: list[str]) -> int:
    """A stable 64-bit hash of some words, the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest("\x1f".join(tokens).encode("utf-8", "surrogatepass"))
