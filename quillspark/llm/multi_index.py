"""Near-duplicate vectors through an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, tune
from .components import connected_components

#: Rows of one side of a block, SHARE of a label's rows within these bounds, and rows that are compared at once in it.
BLOCK, LARGEST, SHARE, TILE = 1024, 32768, 4, 1024
#: Vectors the codebooks are fitted on, least hashes of the id first.
SAMPLE = 4096


@dataclass
class Codebooks:
    """One codebook for each half of the vectors; cells are pairs of codewords."""

    dim: int
    words: list[np.ndarray]
    gaps: list[np.ndarray]
    reach: float  # squared distance to the border of a cell up to which it is visited

    def distances(self, half: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the codewords of a half, and squared least distances to their cells' borders."""
        c = self.words[half]
        d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
        near = np.argmin(d, axis=1)
        edge = np.maximum(0, (d - d[np.arange(len(d)), near][:, None]) / (2 * self.gaps[half][near]))
        return d, edge**2

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.dim // 2
        return x[:, :h], x[:, h:]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (self.distances(k, h)[0].argmin(axis=1) for k, h in enumerate(self.halves(x)))
        return a * len(self.words[1]) + b

    def visits(self, x: np.ndarray, firsts: list[int] | None = None) -> Iterator[list[int]]:
        """For each vector the cells to look into: multi-sequence traversal, nearest border sums first, until they pass reach.

        firsts: first cells of the shelves (runs of cells), ascending; then the shelves of these cells, and the traversal ends when it has met all.
        """
        (_, ea), (_, eb) = (self.distances(k, h) for k, h in enumerate(self.halves(x)))
        width = len(self.words[1])
        for u, v in zip(ea, eb, strict=True):
            oa, ob = np.argsort(u, kind="stable").tolist(), np.argsort(v, kind="stable").tolist()
            su, sv = u[oa].tolist(), v[ob].tolist()
            out, heap, seen = [], [(su[0] + sv[0], 0, 0)], {(0, 0)}
            shelves: set[int] = set()
            while heap:
                d, i, j = heapq.heappop(heap)
                if d > self.reach:
                    break
                cell = oa[i] * width + ob[j]
                if firsts is None:
                    out.append(cell)
                else:
                    shelves.add(max(0, bisect_right(firsts, cell) - 1))
                    if len(shelves) == len(firsts):
                        break
                for n in ((i + 1, j), (i, j + 1)):
                    if n[0] < len(oa) and n[1] < len(ob) and n not in seen:
                        seen.add(n)
                        heapq.heappush(heap, (su[n[0]] + sv[n[1]], *n))
            yield out if firsts is None else sorted(shelves)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(7).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(axis=1)
        for i in range(len(c)):
            if (near == i).any():
                c[i] = x[near == i].mean(axis=0)
    return np.unique(c, axis=0)


def fit(sample: np.ndarray, labels: np.ndarray, words: int, cosine: float, recall: float) -> Codebooks:
    """Codebooks of a sample, and the reach that finds `recall` of the sample's own pairs and of isotropic ones at the very threshold.

    A neighbour at distance r lies beyond a border at distance h with the chance that a random direction has a component over h / r, close to normal with deviation r / sqrt(dim).
    """
    dim = sample.shape[1]
    h = dim // 2
    books = [_kmeans(sample[:, :h], words), _kmeans(sample[:, h:], words)] if h else [np.zeros((1, h)), _kmeans(sample, words)]
    gaps = [np.sqrt(np.maximum(((b[:, None] - b[None]) ** 2).sum(2), 1e-18)) for b in books]
    far = 2 - 2 * cosine
    z = 1.0
    while z < 12 and len(books[0]) * len(books[1]) * math.erfc(z / math.sqrt(2)) / 2 > 1 - recall:
        z += 0.1
    book = Codebooks(dim, books, gaps, min(far + 1e-9, z * z * far / dim))
    g = sample @ sample.T
    a, b = np.where((g >= cosine) & (labels[:, None] == labels[None]) & ~np.eye(len(g), dtype=bool))
    if len(a):
        pick = np.linspace(0, len(a) - 1, min(len(a), 4000)).astype(int)
        a, b = a[pick], b[pick]
        cell = book.cells(sample[b])
        while True:
            got = np.mean([c in v for c, v in zip(cell.tolist(), book.visits(sample[a]), strict=True)])
            if got >= recall or book.reach >= far:
                break
            book.reach = min(far + 1e-9, book.reach * 1.5)
    return book


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least id of its component) that join what links (a, b) join."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    cut = root != np.arange(len(nodes))
    return nodes[cut], nodes[root[cut]]


def near_vectors(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.9999, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of equal label with a cosine (double precision) of at least `cosine`.

    Returns one row for each row of vectors: vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable), kept (vec_id = component_id).
    Every row is in the index. Equal vectors of a label are one class; cells of the product grid lie on shelves, runs of cells with a quarter of the label's classes each (1,024 at least, 32,768 at most). Each class looks once into each shelf that holds a cell which multi-sequence traversal finds within reach, and cosines with all of the shelf are computed there in blocks of bounded size, so a crowded cell is many tasks; blocks return counts and a spanning forest, never pairs. So a class is sent about eight times at most up to 130,000 classes a label, however many cells are within reach.
    Vectors that are null, empty, zero or hold null or non-finite components, rows with a null label and rows with a null id link with nothing (0 links, component vec_id, kept). Vectors of different length have no cosine. A row repeated with its id is one vector. An empty table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    tune(spark)
    x = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"), vectors[label_col].cast("string").alias("label"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists("v", lambda e: e != 0)
    good = x.where("vec_id is not null and label is not null and v is not null").where(finite).distinct()

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(2).to_pylist():
                a = np.array(v)
                a = a / np.abs(a).max()
                out.append((a / np.sqrt(a @ a)).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "u"])

    rows = stored(good.select("vec_id", "label", "v").mapInArrow(unit, "vec_id long, label string, u binary"), "vectors")
    classes = rows.groupBy("label", "u").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    members = rows.join(classes, ["label", "u"]).select("vec_id", "id", "copies")

    per_dim: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        per_dim.setdefault(len(r["u"]) // 8, []).append(r)
    total = rows.count()
    words = min(256, max(4, 2 ** round(math.log2(max(1, total) / 200) / 2))) if total else 4
    books = {}
    for dim, got in per_dim.items():
        s = np.frombuffer(b"".join(r["u"] for r in got), dtype="<f8").reshape(len(got), dim)
        _, lab = np.unique([r["label"] for r in got], return_inverse=True)
        books[dim] = fit(s, lab, words, cosine, recall)
    shared = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            dims = np.array([len(u) // 8 for u in raw])
            cell = [0] * len(raw)
            for dim in np.unique(dims).tolist():
                book = shared.value.get(dim)
                if book is None:  # a length the sample lacks: one cell
                    continue
                at = np.flatnonzero(dims == dim)
                m = np.frombuffer(b"".join(raw[i] for i in at), dtype="<f8").reshape(len(at), dim)
                for i, c in zip(at.tolist(), book.cells(m).tolist(), strict=True):
                    cell[i] = c
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(dims, pa.int32()), pa.array(cell, pa.int32())], ["id", "label", "u", "copies", "dim", "cell"])

    placed = stored(classes.select("id", "label", "u", "copies").mapInArrow(place, "id long, label string, u binary, copies long, dim int, cell int"), "vector-cells")
    kind, key = ["label", "dim"], ["label", "dim", "shelf"]
    # Shelves: cells in order, a new one at each multiple of the block's rows; only labels of several shelves come to the driver, with the first cell of each, in all a row for BLOCK classes at most.
    cells = placed.groupBy(*kind, "cell").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*kind)
    cells = cells.withColumn("rows", F.least(F.lit(LARGEST), F.greatest(F.lit(BLOCK), F.ceil(F.sum("n").over(order) / SHARE)))).withColumn("run", F.floor((F.sum("n").over(order.orderBy("cell")) - F.col("n")) / F.col("rows")))
    cells = stored(cells.withColumn("shelf", F.dense_rank().over(order.orderBy("run")) - 1).select(*kind, "cell", "shelf", "rows"), "vector-shelves")
    starts = cells.groupBy(*key).agg(F.min("cell").alias("first"))
    firsts: dict[tuple[str, int], list[int]] = {}
    for r in starts.join(cells.where("shelf > 0").select(*kind).distinct(), kind, "left_semi").orderBy(*key).collect():
        firsts.setdefault((r["label"], r["dim"]), []).append(r["first"])
    runs = spark.sparkContext.broadcast(firsts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, labels, dims = b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), dtype=object), b.column(3).to_numpy()
            visit = [[0]] * len(raw)
            for label, dim in set(zip(labels.tolist(), dims.tolist(), strict=True)) & runs.value.keys():
                at = np.flatnonzero((labels == label) & (dims == dim))
                m = np.frombuffer(b"".join(raw[i] for i in at), dtype="<f8").reshape(len(at), dim)
                for i, v in zip(at.tolist(), shared.value[dim].visits(m, runs.value[label, dim]), strict=True):
                    visit[i] = v
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(visit, pa.list_(pa.int64()))], ["id", "u", "label", "dim", "visit"])

    stored_at = placed.join(cells, [*kind, "cell"]).select("id", "u", "copies", *key, "rows")
    asked = placed.select("id", "u", "label", "dim").mapInArrow(ask, "id long, u binary, label string, dim int, visit array<long>").select("id", "u", "label", "dim", F.explode("visit").alias("shelf"))
    sizes = stored_at.groupBy(*key).agg(F.count(F.lit(1)).alias("mn"), F.first("rows").alias("rows"))
    # Askers are dealt as if all of the label asked: no count of them is needed.
    asks = sizes.groupBy(*kind).agg(F.sum("mn").alias("pn"))
    blocks = sizes.join(asks, kind).select(*key, F.ceil(F.col("mn") / (2 * F.col("rows"))).cast("int").alias("mb"), F.ceil(F.col("pn") / F.col("rows")).cast("int").alias("pb"))
    m = stored_at.join(blocks, key).select(*key, F.pmod(F.hash("id"), F.col("mb")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("j"), F.lit(False).alias("asks"), "id", "u", "copies")
    p = asked.join(blocks, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), F.pmod(F.hash("id"), F.col("pb")).alias("j"), F.lit(True).alias("asks"), "id", "u", F.lit(0).cast("long").alias("copies"))

    def compare(t: pa.Table) -> pa.Table:
        asks_ = t["asks"].to_numpy(zero_copy_only=False)
        ids, copies = t["id"].to_numpy(), t["copies"].to_numpy()
        v = np.frombuffer(b"".join(t["u"].to_pylist()), dtype="<f8").reshape(len(ids), -1)
        pi, mi = np.flatnonzero(asks_), np.flatnonzero(~asks_)
        n = np.zeros(len(pi), dtype=np.int64)
        at, to = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for lo in range(0, len(pi), TILE):
            for first in range(0, len(mi), TILE):
                x, y = pi[lo : lo + TILE], mi[first : first + TILE]
                a, b = np.nonzero((v[x] @ v[y].T >= cosine) & (ids[x][:, None] != ids[y][None]))
                np.add.at(n, lo + a, copies[y[b]])
                one, two = _forest(ids[x[a]], ids[y[b]])
                at.append(one)
                to.append(two)
        node, root = _forest(np.concatenate(at), np.concatenate(to))
        some = np.flatnonzero(n)
        return pa.table({"a": np.concatenate((ids[pi[some]], node)), "b": np.concatenate((np.zeros(len(some), dtype=np.int64), root)), "n": np.concatenate((n[some], np.full(len(node), -1)))}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))

    found = stored(m.unionByName(p).groupBy(*key, "i", "j").applyInArrow(compare, "a long, b long, n long"), "vector-links")
    counts = found.where("n >= 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    comp = connected_components(found.where("n < 0").select("a", "b").distinct().unionByName(members.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))))
    per = members.join(counts, "id", "left").select("vec_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    out = x.select("vec_id").join(per, "vec_id", "left").join(comp.select(F.col("id").alias("vec_id"), "component"), "vec_id", "left")
    root = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept"))
