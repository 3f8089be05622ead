"""Nearest vectors by matrix products where the vectors lie, and a saved index of vectors in cells.

Queries go to the vectors, in portions of a bounded size; a task keeps the k best of each query and sends no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .fusion import top_per_query

#: Bytes of queries that are broadcast at once; more of them are answered in further passes over the vectors.
PORTION = 32 << 20
#: Cells of an index at most, and rows of the sample a cell that centroids are fitted on: all that the driver holds.
CELLS, PER_CELL = 4096, 16
#: Vectors of the sample whose neighbours decide how many cells are probed.
ASKED = 256
_FOUND = "query_id long, doc_id long, score double"


def units(rows: list[list[float] | None], dim: int) -> np.ndarray:
    """Vectors at length 1; zeros stay, and null ones or those of another length are zeros."""
    return _unit(np.array([np.zeros(dim) if r is None or len(r) != dim else np.array(r, dtype=float) for r in rows]).reshape(len(rows), dim))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of doubles as a matrix; null ones or those of another length, and null components, are zeros."""
    n = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=int)
    if not column.null_count and (n == dim).all():
        flat = column.flatten()
        if not flat.null_count:
            return flat.to_numpy().reshape(len(column), dim)
    return np.array([np.zeros(dim) if r is None or len(r) != dim else np.array([0.0 if e is None else e for e in r]) for r in column.to_pylist()]).reshape(len(column), dim)


def portions(queries: DataFrame, limit: int | None = None) -> Iterator[tuple[np.ndarray, list[list[float]]]]:
    """(ids, vectors) of queries (query_id, embedding), PORTION bytes at a time at most (or so many as limit), dealt by a hash of the id."""
    q = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null"), "queries")
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).collect()[0]
    most = limit or max(1, PORTION // (8 * max(1, size["dim"] or 1)))
    parts = math.ceil(size["n"] / most)
    if parts > 1:
        parts *= 2  # hashes deal unevenly
    for p in range(parts):
        got = (q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) if parts > 1 else q).collect()
        if got:
            yield np.array([r["query_id"] for r in got]), [r["embedding"] for r in got]


def _best(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: places of the queries, ids, scores; equal scores (to 9 digits) by id."""
    score = q @ x.T
    flat = np.round(score, 9)
    if len(ids) > k:
        kth = np.partition(flat, len(ids) - k, axis=1)[:, len(ids) - k]
        a, b = np.nonzero(flat >= kth[:, None])
    else:
        a, b = (i.ravel() for i in np.indices(flat.shape))
    order = np.lexsort((ids[b], -flat[a, b], a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return a[rank < k], ids[b[rank < k]], score[a, b][rank < k]


#: Scores of one matrix product in a task, and of hits that a task holds before it keeps the best.
SCORES, HELD = 1 << 21, 1 << 20


def _tiles(n_rows: int, n_queries: int) -> Iterator[tuple[slice, slice]]:
    """(queries, rows) of matrix products of SCORES elements at most."""
    width = max(1, min(n_rows, 4096, SCORES))
    height = max(1, SCORES // width)
    for lo in range(0, n_rows, width):
        for first in range(0, n_queries, height):
            yield slice(first, min(first + height, n_queries)), slice(lo, min(lo + width, n_rows))


def _kernel(sent, k: int, cells: bool):
    """Rows (doc_id, embedding[, cell]) of a task to the k best of each query of the broadcast (ids, matrix, queries by cell)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, by_cell = sent.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def cut() -> None:
            a, ids, s = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, -np.round(s, 9), a))
            a, ids, s = a[order], ids[order], s[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            held[:] = [(a[keep], ids[keep], s[keep])]

        def add(mine: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
            """The best of some rows for some queries, by products of bounded size; what is held stays in proportion to the queries."""
            nonlocal n, most
            for asked, rows in _tiles(len(ids), len(mine)):
                a, i, s = _best(ids[rows], x[rows], qids, q[mine[asked]], k)
                held.append((mine[asked][a], i, s))
                n += len(a)
                if n > most:
                    cut()
                    n = len(held[0][0])
                    most = max(HELD, 2 * n)

        n, most = 0, HELD
        every = np.arange(len(qids))
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(zero_copy_only=False), _unit(whole(b.column(1), q.shape[1]))
            if cells:
                cell = b.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cell).tolist():
                    mine = by_cell.get(c)
                    if mine is not None:
                        at = np.flatnonzero(cell == c)
                        add(mine, ids[at], x[at])
            else:
                add(every, ids, x)
        if held:
            cut()
            a, ids, s = held[0]
            for lo in range(0, len(a), 1 << 16):
                at = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(qids[a[at]]), pa.array(ids[at]), pa.array(s[at])], ["query_id", "doc_id", "score"])

    return f


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, limit: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest of vectors (doc_id, embedding) for each of queries (query_id, embedding) by cosine, exact.

    Null vectors take no part; zeros and vectors of another length score 0. Without a join: one pass over the vectors for each portion of queries.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("doc_id is not null and embedding is not null")
    out = spark.createDataFrame([], _FOUND)
    for qids, rows in portions(queries, limit):
        dims = {len(r) for r in rows}
        for dim in sorted(dims):
            mine = [i for i, r in enumerate(rows) if len(r) == dim]
            sent = spark.sparkContext.broadcast((qids[mine], units([rows[i] for i in mine], dim), None))
            out = out.unionByName(v.mapInArrow(_kernel(sent, k, False), _FOUND))
    return top_per_query(out, k)


@dataclass
class Cells:
    """A saved index: its folder, centroids, the largest distance of a cell's vectors, and cells that are probed for the recall asked for."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    radii: np.ndarray
    probes: int

    def vectors(self) -> DataFrame:
        """(doc_id, embedding, cell); a condition on cell is a choice of folders."""
        return self.spark.read.schema("doc_id long, embedding array<double>, cell int").parquet(f"{self.path}/vectors")


def _near(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))
    at = d.argmin(axis=1)
    return at, np.sqrt(((x - c[at]) ** 2).sum(1))


def _bounds(q: np.ndarray, c: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What a unit vector of each cell may score with each query at most: by the triangle inequality, and by Cauchy-Schwarz."""
    d = np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] - 2 * q @ c.T + (c * c).sum(1)))
    return np.minimum(1 - np.maximum(0, d - radii) ** 2 / 2, q @ c.T + radii) + 1e-9


def save(vectors: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, k: int = 5) -> Cells:
    """Index of vectors (doc_id, embedding) below path: unit vectors in a folder for each cell, nearest centroid by nearest centroid.

    Centroids (as many as the root of the rows and CELLS at most) come from k-means on a sample by a hash of the id, PER_CELL rows a cell. The same sample tells how many of the nearest cells hold `recall` of the k nearest. Vectors must have one length; null ones are left out.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("doc_id is not null and embedding is not null")
    n = v.count()
    if not n:
        raise ValueError("an index needs at least one vector")
    cells = min(cells or math.isqrt(n - 1) + 1, CELLS)
    # A hash of the id picks the sample: about PER_CELL rows a cell, all rows of a small table.
    got = v.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < max(1, math.ceil(2 * PER_CELL * cells / n * (1 << 20)))).limit(4 * PER_CELL * cells).collect() or v.limit(1).collect()
    dim = len(got[0]["embedding"])
    x = units([r["embedding"] for r in got], dim)
    rng = np.random.default_rng(5)
    c = np.unique(x, axis=0)
    c = c[rng.permutation(len(c))[:cells]].copy()
    for _ in range(6):
        at, _far = _near(x, c)
        total, many = np.zeros_like(c), np.bincount(at, minlength=len(c))
        np.add.at(total, at, x)
        c = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], c)
    asked = rng.permutation(len(x))[:ASKED]
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -2
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    rank = np.argsort(np.argsort(-(x[asked] @ c.T) + (c * c).sum(1) / 2, axis=1), axis=1)
    places = np.sort(np.take_along_axis(rank, _near(x, c)[0][near], axis=1).ravel())
    probes = int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) + 1 if len(places) else 1
    spark.createDataFrame([(i, r.tolist(), probes) for i, r in enumerate(c)], "cell int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    _write(v, path, c, "overwrite")
    return load(spark, path)


def _write(v: DataFrame, path: str, c: np.ndarray, mode: str) -> None:
    sent = v.sparkSession.sparkContext.broadcast(c)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            if any(len(r) != sent.value.shape[1] for r in raw):
                raise ValueError("the vectors of an index have one length")
            x = units(raw, sent.value.shape[1])
            cell, far = _near(x, sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(far), pa.array(cell, pa.int32())], ["doc_id", "embedding", "far", "cell"])

    placed = stored(v.mapInArrow(place, "doc_id long, embedding array<double>, far double, cell int"), "cells")
    # Cells are dealt out whole but for large ones, which AQE splits: a rebalance, not a hash.
    placed.drop("far").hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")
    placed.groupBy("cell").agg(F.max("far").alias("radius")).coalesce(1).write.mode(mode).parquet(f"{path}/radii")


def load(spark: SparkSession, path: str) -> Cells:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # CELLS at most
    radii = np.zeros(len(rows))
    for r in spark.read.parquet(f"{path}/radii").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radii[r["cell"]] = r["radius"]
    return Cells(spark, path, np.array([r["centroid"] for r in rows]), radii * (1 + 1e-9), rows[0]["probes"])


def append(vectors: DataFrame, index: Cells) -> Cells:
    """More vectors into their cells; those there are not touched, and the radii grow."""
    v = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("doc_id is not null and embedding is not null")
    _write(v, index.path, index.centroids, "append")
    return load(index.spark, index.path)


def search(index: Cells, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = False, limit: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest in the `probes` nearest cells of each query (as many as the index was made for, if not given).

    exact: then the cells whose bound reaches the kth score are read too, and the result is that of nearest(). Only the folders of the cells asked for are read.
    """
    spark = index.spark
    out = spark.createDataFrame([], _FOUND)
    for qids, rows in portions(queries, limit):
        q = units(rows, index.centroids.shape[1])
        bound = _bounds(q, index.centroids, index.radii)
        near = np.argsort(-(q @ index.centroids.T) + (index.centroids**2).sum(1) / 2, axis=1, kind="stable")[:, : probes or index.probes]
        ask = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(ask, near, True, axis=1)
        found = stored(_visit(index, qids, q, ask, k), "nearest")
        out = out.unionByName(found)
        if exact:
            kth = {r["query_id"]: r["s"] for r in top_per_query(found, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == k).collect()}  # a row a query of the portion
            least = np.array([kth.get(i, -2.0) for i in qids.tolist()])
            more = (bound >= least[:, None] - 1e-6) & ~ask
            if more.any():
                out = out.unionByName(_visit(index, qids, q, more, k))
    return top_per_query(out, k)


def _visit(index: Cells, qids: np.ndarray, q: np.ndarray, ask: np.ndarray, k: int) -> DataFrame:
    cells = np.flatnonzero(ask.any(axis=0)).tolist()
    sent = index.spark.sparkContext.broadcast((qids, q, {c: np.flatnonzero(ask[:, c]) for c in cells}))
    return index.vectors().where(F.col("cell").isin(cells)).mapInArrow(_kernel(sent, k, True), _FOUND)
