"""Hard negatives by maximum inner product over inverted lists with centroid radii."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_on_key, stored, tune

#: Rows of either side of one block of scores.
BLOCK = 512
#: Centroids at most (32 MB of doubles for 64 components); below that, as many as the root of the rows.
CENTROIDS = 1 << 16
#: Rows of the k-means sample for each centroid, and rounds of k-means.
PER_CENTROID, ROUNDS = 16, 4
#: Vector lengths that get centroids of their own, the most frequent first; rows of others are one list a length.
LENGTHS = 16
#: Norms in units of 1/scale at most: all inner products are then whole numbers that a double holds.
LIMIT = 2.0**53
#: Lists that an anchor visits in the first round, and the factor from round to round.
FIRST, FACTOR = 4, 4
_LOW, _HIGH, _NONE = -(1 << 62), 1 << 62, -(1 << 63) + 1


@dataclass
class Lists:
    """Centroids by vector length, and the largest distance of a list's rows from its centroid."""

    centroids: dict[int, np.ndarray] = field(default_factory=dict)
    radii: dict[int, np.ndarray] = field(default_factory=dict)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and its distance from that centroid (rounded up)."""
        c = self.centroids.get(x.shape[1])
        if c is None:
            return np.zeros(len(x), dtype=np.int32), np.sqrt((x * x).sum(1)) * (1 + 1e-9)
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        return near.astype(np.int32), np.sqrt(((x - c[near]) ** 2).sum(1)) * (1 + 1e-9)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that a row of each list may have with each vector: <x, c> -+ |x| radius, by Cauchy-Schwarz."""
        c = self.centroids.get(x.shape[1], np.zeros((1, x.shape[1])))
        r = self.radii.get(x.shape[1], np.full(1, np.inf))
        norm = np.sqrt((x * x).sum(1))
        mid, far = x @ c.T, np.where(norm[:, None] > 0, norm[:, None], 1e-300) * r
        far = far * (1 + 1e-9) + 1e-9 * norm[:, None] * np.sqrt((c * c).sum(1)) + 1e-6
        return mid - far, mid + far


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<i4").reshape(len(blobs), dim).astype(float)


def _by_length(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) for each vector length."""
    dims = np.array([len(b) // 4 for b in blobs])
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield at, _matrix([blobs[i] for i in at], dim)


def _partial(sent):
    """Sums by list of a partition's vectors, which have one length."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ((dim, c),) = sent.value.centroids.items()
        total, n = np.zeros((len(c), dim)), np.zeros(len(c), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0).to_pylist(), dim)
                near = sent.value.nearest(x)[0]
                np.add.at(total, near, x)
                n += np.bincount(near, minlength=len(c))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64()), pa.array([total[i].tobytes() for i in at], pa.binary())], ["list", "n", "total"])

    return f


def _mean(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype=float) for x in t["total"].to_pylist()) / sum(t["n"].to_pylist())
    return pa.table({"list": t["list"].slice(0, 1), "center": pa.array([total.tobytes()], pa.binary())})


def fit(rows: DataFrame) -> Lists:
    """K-means on rows (v), with rounds as Spark jobs over a sample.

    The sample holds about PER_CENTROID rows a centroid, taken by a hash of the vector; it and the centroids, as many as the root of the rows and CENTROIDS at most, are all that is bounded: each row has its list. Radii come later, of all rows.
    """
    spark = rows.sparkSession
    lists = Lists()
    dims = rows.groupBy((F.length("v") / 4).cast("int").alias("dim")).count().where("dim > 0").orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    for dim, n in dims:
        k = min(math.isqrt(n - 1) + 1, CENTROIDS)
        mine = rows.where(F.length("v") == 4 * dim).select("v")
        sample = stored(mine.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < max(1, math.ceil(PER_CENTROID * k / n * (1 << 20)))).distinct(), "negatives-sample")
        start = sample.orderBy(F.xxhash64(F.lit(1), "v"), "v").limit(k).collect()
        if not start:
            continue
        c = np.unique(_matrix([r["v"] for r in start], dim), axis=0)
        for _ in range(ROUNDS):
            sent = spark.sparkContext.broadcast(Lists({dim: c}))

            got = sample.mapInArrow(_partial(sent), "list int, n long, total binary").groupBy("list").applyInArrow(_mean, "list int, center binary").collect()
            c = c.copy()
            for r in got:
                c[r["list"]] = np.frombuffer(r["center"], dtype=float)
        lists.centroids[dim] = c
    return lists


def _top(t: pa.Table, k: int, same_label: bool) -> list[tuple]:
    """Best k rows of one block for each anchor and window of it: (aid, window, score, vec_id, same vector)."""
    asks = t["asks"].to_numpy(zero_copy_only=False)
    ids, blobs, labels = t["id"].to_numpy(), t["v"].to_pylist(), np.array(t["label"].to_pylist())
    ai, mi = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(ai) or not len(mi):
        return []
    mi = mi[np.argsort(ids[mi], kind="stable")]
    dim = len(blobs[0]) // 4
    a, m = _matrix([blobs[i] for i in ai], dim), _matrix([blobs[i] for i in mi], dim)
    score = (a @ m.T).astype(np.int64)
    score[(labels[ai][:, None] == labels[mi][None]) != same_label] = _LOW - 1
    n = len(mi)
    lo, hi = (t[x].take(pa.array(ai)).to_pylist() for x in ("lo", "hi"))
    out, later = [], np.arange(n)[::-1]
    for w in range(max(map(len, lo))):
        rows = np.array([i for i in range(len(ai)) if len(lo[i]) > w and lo[i][w] <= hi[i][w]], dtype=int)
        if not len(rows):
            continue
        s = score[rows]
        wlo, whi = (np.array([x[i][w] for i in rows], dtype=np.int64)[:, None] for x in (lo, hi))
        key = np.where((s >= wlo) & (s <= whi), s * n + later, _NONE)
        best = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), key.shape)
        for r, i in enumerate(rows.tolist()):
            for j in best[r].tolist():
                if key[r, j] != _NONE:
                    out.append((int(ids[ai[i]]), w, int(s[r, j]), int(ids[mi[j]]), blobs[ai[i]] == blobs[mi[j]]))
    return out


_FOUND = "aid long, w int, score long, vec_id long, same boolean"


def search(rows: DataFrame, anchors: DataFrame, lists: Lists, k: int, same_label: bool) -> DataFrame:
    """The best k of rows for each anchor and window of it, higher inner products first, then smaller ids: (aid, w, score, vec_id, same).

    rows: (vec_id, label, v, dim, list), placed in their lists; anchors: (aid, label, v, lo, hi), with the bounds of one or more windows of scores. Rows of the same label count, or those of others.
    Rounds: each anchor visits its next lists in falling order of their upper bounds, without those that lie outside all its windows, and none whose bound is strictly below the kth score so far of each window that it can reach; the number of lists grows by FACTOR a round. Lists and their visitors are met in blocks of BLOCK rows a side, and blocks return their best k only.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(lists)
    keys = ["dim", "list"] + ["label"] * same_label
    sizes = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("mn")), "negatives-sizes", tidy=False)
    most = max([1, *(len(c) for c in lists.centroids.values())])

    def visits(start: int, end: int):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                blobs, los, his, kths = (b.column(x).to_pylist() for x in ("v", "lo", "hi", "kth"))
                at, to, lo_out = [], [], []
                for places, x in _by_length(blobs):
                    least, most = sent.value.bounds(x)
                    for p, i in enumerate(places.tolist()):
                        lo, hi = np.array(los[i], dtype=float), np.array(his[i], dtype=float)
                        now = lo.copy()
                        for e in kths[i] or []:
                            now[e["w"]] = max(now[e["w"]], e["score"])
                        inside = (least[p][:, None] <= hi) & (lo <= hi)
                        useful = np.flatnonzero((inside & (most[p][:, None] >= lo)).any(axis=1))
                        useful = useful[np.argsort(-most[p][useful], kind="stable")][start:end]
                        useful = useful[(inside[useful] & (most[p][useful][:, None] >= now)).any(axis=1)]
                        at += [i] * len(useful)
                        to += useful.tolist()
                        lo_out += [now.astype(np.int64).tolist()] * len(useful)
                take = pa.array(at, pa.int64())
                got = [b.column(x).take(take) for x in ("aid", "label", "v")]
                dim = pa.array([len(blobs[i]) // 4 for i in at], pa.int32())
                yield pa.RecordBatch.from_arrays([*got, dim, pa.array(to, pa.int32()), pa.array(lo_out, pa.list_(pa.int64())), b.column("hi").take(take)], ["aid", "label", "v", "dim", "list", "lo", "hi"])

        return f

    def compare(t: pa.Table) -> pa.Table:
        got = _top(t, k, same_label)
        cols = zip(*got, strict=True) if got else [[]] * 5
        return pa.table([pa.array(c, y) for c, y in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["aid", "w", "score", "vec_id", "same"])

    found = spark.createDataFrame([], _FOUND)
    best = Window.partitionBy("aid", "w").orderBy(F.desc("score"), "vec_id")
    start, size = 0, FIRST
    while start < most:
        full = found.groupBy("aid", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
        kth = full.groupBy("aid").agg(F.collect_list(F.struct("w", "score")).alias("kth"))
        state = anchors.join(kth, "aid", "left").select("aid", "label", "v", "lo", "hi", "kth")
        asks = stored(state.mapInArrow(visits(start, start + size), "aid long, label string, v binary, dim int, list int, lo array<long>, hi array<long>"), "negatives-asks", tidy=False)
        start, size = start + size, size * FACTOR
        per = asks.groupBy(*keys).agg(F.count(F.lit(1)).alias("pn"))
        blocks = stored(sizes.join(per, keys).select(*keys, F.ceil(F.col("mn") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("pn") / BLOCK).cast("int").alias("pb")), "negatives-blocks", tidy=False)
        if blocks.isEmpty():
            continue
        none = F.lit(None).cast("array<long>")
        m = rows.join(blocks, keys).select(*keys, F.pmod(F.xxhash64("vec_id"), F.col("mb")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("j"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v", *([] if same_label else ["label"]), none.alias("lo"), none.alias("hi"))
        p = asks.join(blocks, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), F.pmod(F.xxhash64("aid"), F.col("pb")).cast("int").alias("j"), F.lit(True).alias("asks"), F.col("aid").alias("id"), "v", *([] if same_label else ["label"]), "lo", "hi")
        new = m.unionByName(p).groupBy(*keys, "i", "j").applyInArrow(compare, _FOUND)
        found = stored(found.unionByName(new).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place"), "negatives-found")
    return found


def hard_negatives(vectors: DataFrame, anchors: F.Column, scale: float = 256.0, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each row where `anchors` holds (a condition on the columns of vectors) its nearest rows of the same label, and for each of those the nearest rows of other labels that score between `least` and `most` percent of it.

    Components become floor(scale * x) and scores are whole inner products; higher ones come first, equal ones by smaller id. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for an anchor the first `positives` other rows of its label, for each of them the first `negatives` of other labels in the window (all, if fewer; a positive without any, such as one with a score below zero, has no row).
    Exact: lists are visited by Cauchy-Schwarz bounds (see search). Of equal rows of a label only the `positives` + 1 with the least ids are in the lists, as no others can come first, and equal anchors are searched for once.
    Rows with a null id, label or vector or with null or non-finite components take no part. Vectors of different length have no score; empty ones score 0 with each other. A row repeated as a whole is one row; an id with several labels or vectors is several rows. A vector whose norm times scale is over 2^26.5 raises an error, as scores would not be exact. An empty table gives no rows, and other columns are only seen by `anchors`.
    """
    spark = vectors.sparkSession
    tune(spark)
    x = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("e"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    good = x.where("vec_id is not null and label is not null and e is not null").where(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for e in b.column(2).to_pylist():
                v = np.floor(np.array(e, dtype=float) * scale)
                if (v * v).sum() >= LIMIT:
                    raise ValueError("hard_negatives: a vector is too long for exact scores; choose a smaller scale")
                out.append(v.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), b.column(3)], ["vec_id", "label", "v", "anchor"])

    all_rows = stored(good.mapInArrow(whole, "vec_id long, label string, v binary, anchor boolean"), "negatives-rows")
    # Nothing equal beyond these can come first anywhere; the limit by group is applied before the shuffle, too.
    keep = max(positives + 1, negatives)
    few = all_rows.select("vec_id", "label", "v").distinct().withColumn("place", F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))).where(F.col("place") <= keep).drop("place")
    lists = fit(all_rows)
    sent = spark.sparkContext.broadcast(lists)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(2).to_pylist()
            near, far, dim = np.zeros(len(blobs), dtype=np.int32), np.zeros(len(blobs)), np.zeros(len(blobs), dtype=np.int32)
            for at, v in _by_length(blobs):
                near[at], far[at] = sent.value.nearest(v)
                dim[at] = v.shape[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dim), pa.array(near), pa.array(far)], ["vec_id", "label", "v", "dim", "list", "far"])

    placed = stored(few.mapInArrow(place, "vec_id long, label string, v binary, dim int, list int, far double"), "negatives-lists")
    known = F.col("dim").isin(list(lists.centroids) or [-1])
    for r in placed.where(known).groupBy("dim", "list").agg(F.max("far").alias("far")).collect():  # a row a centroid
        lists.radii.setdefault(r["dim"], np.zeros(len(lists.centroids[r["dim"]])))[r["list"]] = r["far"]
    placed = placed.drop("far")

    asking = all_rows.where("anchor").select("vec_id", "label", "v").distinct()
    classes = stored(asking.select("label", "v").distinct().withColumn("aid", F.monotonically_increasing_id()), "negatives-anchors", tidy=False)
    whole_range = classes.withColumns({"lo": F.array(F.lit(_LOW).cast("long")), "hi": F.array(F.lit(_HIGH).cast("long"))})
    pos = search(placed, whole_range, lists, positives + 1, True)

    # Windows of whole scores, one for each different score of a positive.
    windows = pos.select("aid", "score").distinct().withColumn("w", F.row_number().over(Window.partitionBy("aid").orderBy("score")) - 1)
    windows = stored(windows.withColumns({"lo": -F.expr(f"(-score * {least} - pmod(-score * {least}, 100)) div 100"), "hi": F.expr(f"(score * {most} - pmod(score * {most}, 100)) div 100")}), "negatives-windows", tidy=False)
    bounds = windows.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("w", "lo", "hi"))).alias("s")).select("aid", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
    wanted = stored(classes.join(bounds, "aid"), "negatives-wanted", tidy=False)
    neg = search(placed, wanted, lists, negatives, False)

    some = neg.groupBy("aid", "w").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("negatives"))
    per_score = windows.join(some, ["aid", "w"]).select("aid", "score", "negatives")
    result = pos.join(per_score, ["aid", "score"], "left").groupBy("aid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id", "same", "negatives"))).alias("positives"))
    per_class = stored(classes.join(result, "aid").select("label", "v", "positives"), "negatives-classes")
    out = join_on_key(asking, per_class, ["label", "v"]).select(F.col("vec_id").alias("anchor_id"), "positives")
    out = out.withColumn("p", F.explode(F.slice(F.filter("positives", lambda p: ~(p["same"] & (p["vec_id"] == F.col("anchor_id")))), 1, positives)))
    out = out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (-F.col("p.down")).alias("positive_score"), F.posexplode("p.negatives").alias("place", "n"))
    return out.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", (-F.col("n.down")).alias("negative_score"))
