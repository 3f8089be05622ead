"""Near-duplicate passages by compact windows.

For one hash function, all runs of at least `least` shingles of a text fall into few compact windows (l, c, r): every run [i, j] with l <= i <= c <= j <= r has its least hash at c. The windows are the nodes of the Cartesian tree over the hashes that span enough shingles. Two passages agree on a hash function with the probability of their sets' similarity, and then lie in windows with one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, join_on_key, shuffle_width, small, stored, text_batches
from .words import _powers, hash_words, mix, mix_int, shingle

#: Words of a shingle, least words of a passage, hash functions, and how many of them must agree.
WIDTH, WORDS, HASHES, AGREE = 5, 50, 5, 2
SIMILARITY = 0.8

def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the width values from each place on, where there are so many."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def compact_windows(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all windows of at least `least` places within the disjoint runs [lo, hi) of h, in order; equal hashes: the left one counts as less.

    A node of the Cartesian tree spans so many places if and only if it is the least of some run of `least`, and its ancestors then do too. So the tree is built of those places alone; all nodes of one depth are found together.
    """
    keep = hi - lo >= least
    lo, hi = lo[keep], hi[keep]
    if not len(lo):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    bits = np.uint64(max(20, len(h).bit_length()))
    code = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    n = hi - lo - least + 1
    starts = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
    at = sliding_least(code, least)[starts]
    place = (at[np.concatenate(([True], at[1:] != at[:-1]))] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    few = np.append(code[place], ~np.uint64(0))
    order = np.argsort(np.argsort(few)).astype(np.int64) * len(few) + np.arange(len(few))
    x, y, l, r = np.searchsorted(place, lo), np.searchsorted(place, hi), lo, hi - 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(x):
        at = np.empty(2 * len(x), dtype=np.int64)
        at[::2], at[1::2] = x, y
        k = np.minimum.reduceat(order, at)[::2] % len(few)
        c = place[k]
        out.append((l, c, r))
        x, y, l, r = (np.stack(v, axis=1).reshape(-1) for v in ((x, k + 1), (k, y), (l, c + 1), (c - 1, r)))
        some = y > x
        x, y, l, r = x[some], y[some], l[some], r[some]
    l, c, r = (np.concatenate(v) for v in zip(*out, strict=True))
    by = np.argsort(c)
    return l[by], c[by], r[by]


def _anew(h: np.ndarray, own: np.ndarray, value: np.ndarray, c: np.ndarray, hi: np.ndarray, least: int) -> np.ndarray:
    """Which windows (of text own, with least hash value at c) a passage can need: not those whose place and the one before with this value are a period apart, of fewer than `least` places, that repeats after c.

    A passage that starts within that period has the same shingles if it starts a period earlier, so it is found through the window before.
    """
    pw, inv = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * pw[: len(h)], out=sums[1:])
    order = np.lexsort((c, value, own))
    a, b = order[:-1], order[1:]
    p = c[b] - c[a]
    ok = (own[a] == own[b]) & (value[a] == value[b]) & (p < least)
    b, p = b[ok], p[ok]
    ok = c[b] + p <= hi[own[b]]
    b, p = b[ok], p[ok]
    x = c[b]
    same = (sums[x] - sums[x - p]) * inv[x - p] == (sums[x + p] - sums[x]) * inv[x]
    out = np.ones(len(c), dtype=bool)
    out[b[same]] = False
    return out


def salt(f: int) -> np.uint64:
    return np.uint64((0xA24BAED4963EE407 * (f + 1)) & ((1 << 64) - 1))


def _packed(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _unpacked(b: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.frombuffer(raw.reshape(np.dtype(dtype).itemsize, -1).T.tobytes(), dtype=dtype)


def _windows(docs: DataFrame, buckets: int) -> DataFrame:
    """Compact windows of docs (doc_id, text) under every hash function, packed by the bucket of their value: (bucket, values, docs, places), places being c, c - l and r - c of each window."""
    least = WORDS - WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, batch in text_batches(batches, 2 << 20):
            h, first, *_ = hash_words(batch)
            s = shingle(h, WIDTH)
            lo, hi = first[:-1], np.maximum(first[:-1], first[1:] - WIDTH + 1)
            own = np.array(keys, dtype=np.int64)
            for f in range(HASHES):
                v = mix(s ^ salt(f))
                l, c, r = compact_windows(v, lo, hi, least)
                if not len(l):
                    continue
                doc = np.searchsorted(first, c, side="right") - 1
                need = _anew(s, doc, v[c], c, hi, least)
                l, c, r, doc = l[need], c[need], r[need], doc[need]
                base = first[doc]
                value = v[c]
                bucket = (value % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                groups = [order[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                place = np.stack((c - base, c - l, r - c), axis=1).astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[g[0]]) for g in groups], pa.int32()), pa.array([f] * len(groups), pa.int32()), pa.array([_packed(value[g].astype("<u8")) for g in groups], pa.binary()), pa.array([_packed(own[doc[g]].astype("<i8")) for g in groups], pa.binary()), pa.array([_packed(place[g].reshape(-1)) for g in groups], pa.binary())],
                    ["bucket", "f", "values", "docs", "places"],
                )

    return docs.mapInArrow(run, "bucket int, f int, values binary, docs binary, places binary")


SEEDS = "doc_id long, partner long, f int, c int, l int, r int, pc int, pl int, pr int, value long, docs int, n int"


def _seeds(t: pa.Table) -> pa.Table:
    """Windows of one bucket whose value several documents have, each with the first such document's windows, taken together; with the value and the group's documents and windows. Where a group has three documents or more, the first one's windows come too, with itself as partner."""
    value = np.concatenate([_unpacked(x, "<u8") for x in t["values"].to_pylist()])
    doc = np.concatenate([_unpacked(x, "<i8") for x in t["docs"].to_pylist()])
    place = np.concatenate([_unpacked(x, "<i4") for x in t["places"].to_pylist()]).reshape(-1, 3)
    order = np.lexsort((place[:, 0], doc, value))
    value, doc, place = value[order], doc[order], place[order]
    lead = np.concatenate(([True], value[1:] != value[:-1]))
    new = np.flatnonzero(lead)
    size = np.diff(np.concatenate((new, [len(value)])))
    first = np.repeat(new, size)
    docs = np.repeat(np.add.reduceat((lead | np.concatenate(([True], doc[1:] != doc[:-1]))).astype(np.int64), new), size)
    l, r = place[:, 0] - place[:, 1], place[:, 0] + place[:, 2]
    own = doc == doc[first]
    pl = np.repeat(np.minimum.reduceat(np.where(own, l, np.iinfo(np.int32).max), new), size)
    pr = np.repeat(np.maximum.reduceat(np.where(own, r, -1), new), size)
    at = np.flatnonzero(~own | (docs > 2))
    to = first[at]
    cols = [doc[at], doc[to], np.full(len(at), t["f"][0].as_py()), place[at, 0], l[at], r[at], place[to, 0], pl[at], pr[at], value[at].view(np.int64), docs[at], np.repeat(size, size)[at]]
    return pa.table([pa.array(c.astype(np.int64 if k in (0, 1, 9) else np.int32)) for k, c in enumerate(cols)], names=[x.split()[0] for x in SEEDS.split(", ")])


#: Least shingles of a passage.
LEAST = WORDS - WIDTH + 1


def _enough(common: np.ndarray | int, union: np.ndarray | int) -> np.ndarray | bool:
    return common >= SIMILARITY * union - 1e-9


def _padded(i: int, j: int, n: int) -> tuple[int, int]:
    """[i, j] with neighbours within n places, so that it has LEAST ones."""
    if j - i + 1 < LEAST:
        j = min(i + LEAST - 1, n - 1)
        i = max(0, j - LEAST + 1)
    return i, j


def _run(b: np.ndarray, a: np.ndarray, at: int) -> tuple[int, int, int, int, float] | None:
    """The longest run of b around `at` that is as similar as asked to a run of a: (first and last place in b, in a, similarity).

    Runs begin and end with shared shingles and cross any gaps between; one that is too short takes neighbours along up to LEAST.
    """
    held = np.isin(b, a)
    if min(len(a), len(b)) < LEAST or not held[at]:
        return None
    edge = np.flatnonzero(np.diff(np.concatenate(([False], held, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2] - 1
    starts, ends = starts[starts <= at], ends[ends >= at]
    size = ends[None] - starts[:, None] + 1
    # No run can do that holds too few shared shingles for its own others, and for the other text's between its ends.
    (_, one), (known, place) = np.unique(b, return_index=True), np.unique(a, return_index=True)
    lone = np.zeros(len(b), dtype=bool)
    lone[one] = True
    c, u = np.concatenate(([0], np.cumsum(held))), np.concatenate(([0], np.cumsum(~held & lone)))
    common, rest = c[ends + 1][None] - c[starts][:, None], u[ends + 1][None] - u[starts][:, None]
    union = common + rest
    if len(one) == len(b) and len(known) == len(a):
        to = lambda x: place[np.searchsorted(known, b[x])]
        union = np.maximum(size, LEAST) + np.maximum(np.abs(to(ends)[None] - to(starts)[:, None]) + 1, LEAST) - common
    p, q = np.nonzero(_enough(common, union))
    lone = np.zeros(len(a), dtype=bool)
    lone[place] = True
    other = np.concatenate(([0], np.cumsum(~np.isin(a, b) & lone)))
    spots: dict[int, np.ndarray] = {}
    for k in np.argsort(-size[p, q], kind="stable").tolist():
        i, j = int(starts[p[k]]), int(ends[q[k]])
        for x in (i, j):
            if x not in spots:
                spots[x] = np.flatnonzero(a == b[x])
        m, n = spots[i], spots[j]
        off = np.abs(n[None] - m[:, None] - (j - i))
        x, y = divmod(int(off.argmin()), len(n))
        m, n = sorted((int(m[x]), int(n[y])))
        most = int(common[p[k], q[k]])
        if j - i + 1 >= LEAST and n - m + 1 >= LEAST and not _enough(most, most + int(rest[p[k], q[k]]) + int(other[n + 1] - other[m])):
            continue
        i, j = _padded(i, j, len(b))
        m, n = _padded(m, n, len(a))
        x, y = np.unique(b[i : j + 1]), np.unique(a[m : n + 1])
        both = len(np.intersect1d(x, y, assume_unique=True))
        if _enough(both, len(x) + len(y) - both):
            return i, j, m, n, both / (len(x) + len(y) - both)
    return None


def _reach(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each of starts the last place whose sum p is no less than there; p is seen from its end."""
    top = np.maximum.accumulate(p[::-1])[::-1]
    return np.searchsorted(-top, -p[starts], side="right") - 1


def _possible(held: np.ndarray, lone: np.ndarray, each: int) -> np.ndarray:
    """Which places lie in a run of LEAST places or more that has `each` shared shingles for each other one, repeated ones not counted."""
    p = np.concatenate(([0], np.cumsum(np.where(held, 1, np.where(lone, -each, 0)))))
    far = _reach(p, np.arange(len(p)))
    far = np.maximum.accumulate(np.where(far - np.arange(len(p)) >= LEAST, far, 0))
    return far[:-1] > np.arange(len(held))


def _firsts(x: np.ndarray, size: int) -> np.ndarray:
    """Which places hold a number below size that isn't before."""
    place = np.empty(size, dtype=np.int64)
    place[x[::-1]] = np.arange(len(x) - 1, -1, -1)
    return place[x] == np.arange(len(x))


def _among(x: np.ndarray, a: np.ndarray, size: int) -> np.ndarray:
    """Which places of x hold a number of a, all below size."""
    mark = np.zeros(size, dtype=bool)
    mark[a] = True
    return mark[x]


def _quick(b: np.ndarray, a: np.ndarray, at: int, held: np.ndarray) -> tuple[int, int, int, int, float] | None:
    """As _run, for a run in which eight of nine shingles are shared, if there is one."""
    p = np.concatenate(([0], np.cumsum(np.where(held, 1, -8))))
    top = np.maximum.accumulate(p[: at : -1])[::-1]
    ends = np.searchsorted(-top, -p[: at + 1], side="right") + at
    i = int((ends - np.arange(at + 1)).argmax())
    j = int(ends[i]) - 1
    if j < at or j - i + 1 < LEAST:
        return None
    shared = np.flatnonzero(held[i : j + 1])
    i, j = i + int(shared[0]), i + int(shared[-1])
    m, n = np.flatnonzero(a == b[i]), np.flatnonzero(a == b[j])
    off = np.abs(n[None] - m[:, None] - (j - i))
    x, y = divmod(int(off.argmin()), len(n))
    m, n = sorted((int(m[x]), int(n[y])))
    i, j = _padded(i, j, len(b))
    m, n = _padded(m, n, len(a))
    x, y = np.unique(b[i : j + 1]), np.unique(a[m : n + 1])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return (i, j, m, n, both / (len(x) + len(y) - both)) if _enough(both, len(x) + len(y) - both) else None


def _best(b: np.ndarray, a: np.ndarray, at: int) -> tuple[int, int, int, int, float] | None:
    """A run of b around `at` that is as similar as asked to a run of a, as _run gives it: by the quick way where that decides. Shingles are small numbers here."""
    if min(len(a), len(b)) < LEAST:
        return None
    held = _among(b, a, int(max(a.max(), b.max())) + 1)
    if not held[at]:
        return None
    return _quick(b, a, at, held) or _run(b, a, at)


def passages(a: np.ndarray, b: np.ndarray, seeds: np.ndarray | list[tuple[int, ...]]) -> list[tuple[int, int, int, int, float]]:
    """Verified passages of b that a holds: (first word, end word, first and end word in a, similarity), from seeds (c, l, r in b; c, l, r in a)."""
    out: list[tuple[int, int, int, int, float]] = []
    known, number = np.unique(np.concatenate((a, b)), return_inverse=True)
    size = len(known)
    a, b = number[: len(a)], number[len(a) :]
    in_a, lone = _among(b, a, size), _firsts(b, size)
    # Four of five shingles of a run are shared, and eight of nine of the shorter run of the two: common >= 0.8 * (both - common).
    can = _possible(in_a, lone, 4)
    if not can.any():
        return out
    dense, other = _possible(in_a, lone, 8), _possible(_among(a, b, size), _firsts(a, size), 8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], can, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    done = np.zeros(len(b), dtype=bool)
    failed: set[tuple] = set()
    # A run lies between places that no run can cross.
    x = np.asarray(seeds, dtype=np.int64).reshape(-1, 6)
    x = x[can[x[:, 0]] & (dense[x[:, 0]] | other[x[:, 3]])]
    k = np.searchsorted(starts, x[:, 0], side="right") - 1
    x = np.stack((x[:, 0], np.maximum(x[:, 1], starts[k]), np.minimum(x[:, 2] + 1, ends[k]), x[:, 4], x[:, 5]), axis=1)
    x = x[x[:, 2] - x[:, 1] >= LEAST]
    for cb, lo, hi, la, ra in x[np.lexsort((x[:, 0], x[:, 1] - x[:, 2]))].tolist():
        if done[cb]:
            continue
        # Where a document repeats itself, places that look alike over twice a passage's length on either side are tried once.
        like = (b[max(lo, cb - 2 * LEAST) : cb].tobytes(), b[cb : min(hi, cb + 2 * LEAST)].tobytes(), la, ra)
        if like in failed:
            continue
        got = _best(b[lo:hi], a[la : ra + 1], cb - lo)
        if got:
            i, j, m, n, similarity = got
            i, j = i + lo, j + lo
            if not any(x[0] <= i and j + WIDTH <= x[1] for x in out):
                out = [x for x in out if not (i <= x[0] and x[1] <= j + WIDTH)]
                out.append((i, j + WIDTH, m + la, n + la + WIDTH, similarity))
            done[i : j + 1] = True
        else:
            failed.add(like)
    return sorted(out)


#: Most windows of a group that meet at once are two blocks of about so many.
BLOCK = 2048


#: Pairs of windows that are looked at at once; an array of them has some hundred places each.
PAIRS = 16_384

#: Bits that stand for the shingles around a place, those of a first look, and how many of them the places of one passage without repetition share at least.
BITS, LOOK, COMMON = 4096, 512, 36


def _shared(shingles: np.ndarray, at: int) -> int:
    """Bits of the first look that a passage around place `at` shares with a similar one at least.

    Of LEAST shingles or more around the place, one of nine distinct ones may be missing, so that no more bits than these can; a passage that repeats itself has few distinct ones to begin with. Two bits less for shingles beyond those of the shortest run that stand for no new bit.
    """
    n = len(shingles)
    starts = np.arange(max(0, at - LEAST + 1), max(0, min(at, n - LEAST)) + 1)
    places = np.arange(n)
    within = (places >= starts[:, None]) & (places < starts[:, None] + LEAST)

    def distinct(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x, kind="stable")
        before = np.full(n, -1)
        same = x[order][1:] == x[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        return (within & (before < starts[:, None])).sum(axis=1)

    return max(1, min(COMMON, int((distinct(shingles % LOOK) - distinct(shingles) // 9).min()) - 2))


def _dense(marks: np.ndarray, places: np.ndarray, size: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of windows (x, y): whether a run of LEAST shingles or more of x around its place has eight of nine in y, going by the bits of y.

    marks: the bits of each window; places: its shingles' bits, padded; size, at: its shingles and the place among them. The shorter side of a pair of runs that are similar enough has so many, as common >= 0.8 * (both - common) makes common >= 8/9 of it.
    """
    width = places.shape[1]
    held = marks[y[:, None], places[x]]
    p = np.zeros((len(x), width + 1), dtype=np.int32)
    np.cumsum(np.where(held, np.int32(1), np.int32(-8)), axis=1, out=p[:, 1:])
    p[np.arange(width + 1)[None] > size[x][:, None]] = -(1 << 30)
    top = np.maximum.accumulate(p[:, ::-1], axis=1)[:, ::-1]
    out = np.zeros(len(x), dtype=bool)
    row, place = np.arange(len(x)), at[x]
    for i in range(width - LEAST + 1):
        out |= (i <= place) & (top[row, np.minimum(np.maximum(i + LEAST, place + 1), width)] >= p[:, i])
    return out


def _meet(group: np.ndarray, doc: np.ndarray, part: np.ndarray, wanted: np.ndarray, sets: list[np.ndarray], at: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of windows (later, earlier) of one group that hold a common passage around their places: for each wanted one the first found.

    The windows are sorted by group and document; part: the block of each where two blocks meet, else -1.
    """
    size = np.array([len(s) for s in sets])
    width = max(2 * AROUND + 1, int(size.max()))
    places = np.zeros((len(sets), width), dtype=np.int16)
    inside = np.arange(width)[None] < size[:, None]
    places[inside] = np.concatenate(sets) % BITS
    marks = np.zeros((len(sets), BITS), dtype=bool)
    marks[np.nonzero(inside)[0], places[inside]] = True
    look = np.packbits(marks.reshape(len(sets), -1, LOOK).any(axis=1), axis=1).view(np.uint64)
    # Windows with some repeated shingles; the others have COMMON bits and more.
    raw = np.full((len(sets), width), -1, dtype=np.int32)
    raw[inside] = np.concatenate(sets)
    raw.sort(axis=1)
    shared = np.full(len(sets), COMMON, dtype=np.int16)
    for i in np.flatnonzero(((raw[:, 1:] == raw[:, :-1]) & (raw[:, 1:] >= 0)).sum(axis=1) > 2).tolist():
        shared[i] = _shared(sets[i], int(at[i]))
    first = np.searchsorted(group, group)
    later = np.flatnonzero(wanted & (first < np.arange(len(group))))
    n = later - first[later]
    out: list[tuple[int, int]] = []
    lo, total = 0, np.cumsum(n)
    while lo < len(later):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")))
        m = n[lo:hi]
        k = np.repeat(later[lo:hi], m)
        j = np.arange(len(k)) - np.repeat(np.cumsum(m) - m, m) + first[k]
        ok = (doc[j] < doc[k]) & ((part[j] != part[k]) | (part[k] < 0))
        k, j = k[ok], j[ok]
        ok = np.bitwise_count(look[k] & look[j]).sum(axis=1) >= np.minimum(shared[k], shared[j])
        k, j = k[ok], j[ok]
        ok = _dense(marks, places, size, at, k, j)
        ok[~ok] = _dense(marks, places, size, at, j[~ok], k[~ok])
        found = -1
        for x, y in zip(k[ok].tolist(), j[ok].tolist(), strict=True):
            if x != found and _best(sets[x], sets[y], int(at[x])):
                found = x
                out.append((x, y))
        lo = hi
    return out


#: Places around the least shingle that windows are compared on, and those on each side whose least hash under one more function deals the windows of a value out.
AROUND, SIDE = LEAST - 1, LEAST // 2 - 1


def _others(hits: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
    """(stored) Seeds (doc_id, partner, seeds) between the windows (hits, which go) of a group besides those to its first document, for places not in the passages found.

    Windows of one value are dealt out anew by the least hash of the shingles on the left, and of those on the right; a passage has at least half of its own on one side. Windows of a document that look alike count once.
    """
    spark, groups = hits.sparkSession, hits.where("docs > 2")
    cover = found.select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id").agg(F.collect_set(F.struct("s.first", "s.end")).alias("cover"))
    # Only groups with a place of a later document that no passage holds.
    w = F.col("s")
    marked = groups.groupBy("doc_id").agg(F.collect_list(F.struct("value", "f", "c", "l", "r", (F.col("doc_id") != F.col("partner")).alias("later"))).alias("w")).join(cover, "doc_id", "left")
    bare = ~F.coalesce(F.exists("cover", lambda x: (x["first"] <= w["c"]) & (w["c"] + WIDTH <= x["end"])), F.lit(False))
    marked = stored(marked.select("doc_id", F.explode("w").alias("s"), "cover").select("doc_id", "s.*", (w["later"] & bare).alias("wanted")), "passage-marked")
    discard(hits)
    live = marked.groupBy("value", "f").agg(F.max("wanted").alias("any"), F.count(F.lit(1)).alias("n")).where("any").select("value", "f", "n")
    held = join_on_key(marked, live, ["value", "f"], rows="n").groupBy("doc_id").agg(F.collect_list(F.struct("value", "f", "c", "l", "r", "wanted")).alias("w"))
    ids = stored(held.select("doc_id"), "passage-ids")
    held = held.hint("merge").join(docs.join(small(ids), "doc_id", "left_semi").select("doc_id", "text"), "doc_id").select("doc_id", "text", "w")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                yield _around(b.slice(lo, 64))

    m = stored(held.mapInArrow(cut, "key long, look long, f int, c int, l int, r int, lo_at int, doc_id long, wanted boolean, shingles binary"), "passage-around")
    discard(marked, ids)
    # Windows that look alike are one; its first document is the partner of the others.
    alike = stored(m.groupBy("key", "look").agg(F.min(F.struct("doc_id", "f", "c", "l", "r", "lo_at", "wanted", "shingles")).alias("s"), F.count(F.lit(1)).alias("rows")).select("key", "look", "rows", "s.*"), "passage-alike")
    to = alike.select("key", "look", "rows", F.col("doc_id").alias("partner"), F.col("c").alias("pc"), F.col("l").alias("pl"), F.col("r").alias("pr"))
    exact = stored(join_on_key(m.where("wanted").select("key", "look", "doc_id", "f", "c", "l", "r"), to, ["key", "look"], rows="rows").where("partner < doc_id").select(*(x.split()[0] for x in PAIR.split(", "))), "passage-alike-pairs")
    discard(m)
    sizes = alike.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max(F.when(F.col("wanted"), F.col("doc_id"))).alias("last")).where("last > least").select("key", "n")
    m = join_on_key(alike.drop("rows", "look"), sizes, ["key"], rows="n").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("blocks", "other", "n")
    key = ["key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            x = {c: t[c].to_numpy() for c in ("key", "lo", "hi", "part", "doc_id", "wanted", "f", "c", "l", "r", "lo_at")}
            new = np.concatenate(([True], (x["key"][1:] != x["key"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1])))
            sets = [np.frombuffer(s, dtype="<u2") for s in t["shingles"].to_pylist()]
            pairs = _meet(np.cumsum(new), x["doc_id"], np.where(x["lo"] == x["hi"], -1, x["part"]), x["wanted"], sets, x["c"] - x["lo_at"])
            if pairs:
                k, j = (np.array(p) for p in zip(*pairs, strict=True))
                cols = (x["doc_id"][k], x["doc_id"][j], x["f"][k], x["c"][k], x["l"][k], x["r"][k], x["c"][j], x["l"][j], x["r"][j])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], PAIR.replace(" long", "").replace(" int", "").split(", "))

        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            # The last group may go on in the next batch.
            lead = [t[c].to_numpy() for c in key]
            same = np.logical_and.reduce([c == c[-1] for c in lead])
            last = int(np.argmax(same))
            yield from met(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None:
            yield from met(rest)

    pairs = m.repartition(shuffle_width(spark), *key).sortWithinPartitions(*key, "doc_id").mapInArrow(run, PAIR).unionByName(exact)
    out = stored(pairs.groupBy("doc_id", "partner").agg(seed_list()), "passage-seeds")
    discard(alike, exact)
    return out


def seed_list() -> F.Column:
    return F.collect_list(F.struct("f", "c", "l", "r", "pc", "pl", "pr")).alias("seeds")


def _around(b: pa.RecordBatch) -> pa.RecordBatch:
    """The windows of some documents (doc_id, text, windows) with the shingles around their places, under the keys of their sides; those of a document that look alike under one function count once."""
    h, first, *_ = hash_words(b.column(1).to_pylist())
    s = shingle(h, WIDTH)
    last = np.maximum(first[:-1], first[1:] - WIDTH + 1)
    held = b.column(2)
    at = held.offsets.to_numpy()
    own = np.repeat(np.arange(b.num_rows), np.diff(at))
    w = held.values.slice(int(at[0]), len(own))
    value, f, c, l, r, wanted = (w.field(i).to_numpy(zero_copy_only=False) for i in range(6))
    base = first[own]
    c, l, r = (x.astype(np.int64) + base for x in (c, l, r))
    lo, hi = np.maximum(l, c - AROUND), np.minimum(r, c + AROUND) + 1
    ok = r < last[own]
    pw, inv = _powers(len(s) + 1)
    sums = np.zeros(len(s) + 1, dtype=np.uint64)
    np.cumsum(s * pw[: len(s)], out=sums[1:])
    at_lo, at_hi = np.where(ok, lo, 0), np.where(ok, hi, 0)
    look = mix((sums[at_hi] - sums[at_lo]) * inv[at_lo] + (c - lo).astype(np.uint64)).view(np.int64)
    order = np.lexsort((c, look, f, own))
    order = order[ok[order]]
    new = np.concatenate(([True], (look[order[1:]] != look[order[:-1]]) | (f[order[1:]] != f[order[:-1]]) | (own[order[1:]] != own[order[:-1]])))[: len(order)]
    side = np.append(mix(s ^ salt(HASHES)), np.full(SIDE, ~np.uint64(0)))
    grid = np.concatenate((side, np.full(-len(side) % SIDE, ~np.uint64(0)))).reshape(-1, SIDE)
    ahead, behind = np.minimum.accumulate(grid, axis=1).reshape(-1), np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    x = order[new]
    keys, rows = [], []
    for k, (there, start) in enumerate(((c - l >= SIDE, c - SIDE), (r - c >= SIDE, c + 1))):
        y = x[there[x]]
        least = np.minimum(behind[start[y]], ahead[start[y] + SIDE - 1])
        keys.append(value[y] ^ mix(least + (2 * f[y] + k).astype(np.uint64)).view(np.int64))
        rows.append(y)
    key, y = np.concatenate(keys), np.concatenate(rows)
    short = (s >> np.uint64(48)).astype("<u2")
    text = [short[a:e].tobytes() for a, e in zip(lo[y].tolist(), hi[y].tolist(), strict=True)]
    ids = b.column(0).to_numpy()
    cols = (key, look[y], f[y], (c - base)[y], (l - base)[y], (r - base)[y], (lo - base)[y], ids[own[y]], wanted[y], text)
    return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(cols, WIDE, strict=True)], schema=WIDE)


PAIR = "doc_id long, partner long, f int, c int, l int, r int, pc int, pl int, pr int"
WIDE = pa.schema([("key", pa.int64()), ("look", pa.int64()), ("f", pa.int32()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32()), ("lo_at", pa.int32()), ("doc_id", pa.int64()), ("wanted", pa.bool_()), ("shingles", pa.binary())])


FOUND = "doc_id long, th long, partner long, words int, spans array<struct<first:int,end:int,a:int,b:int,partner_first:int,partner_end:int,similarity:double>>"


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, th, partner, words, spans): passages of at least WORDS words that resemble (similarity SIMILARITY or more on WIDTH-word shingles) a passage of an earlier document, the partner.

    In every group of windows with one value each document is first compared with the least one, if two functions agree on it. Where a group has more documents, their windows then meet in blocks of bounded size, and a pair counts that adds to the passages found before; so a passage in any number of documents gives about one row for each of them, and a document isn't compared with others that repeat what it has.
    th is the hash of the text; spans: words [first, end), bytes [a, b), the partner's words and the similarity. docs: doc_id, text.
    Windows travel packed by the bucket of their value; a bucket is read once, its windows sorted.
    """
    spark = docs.sparkSession
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    d = d.withColumn("th", F.xxhash64("text"))
    hits = stored(_windows(d.select("doc_id", "text"), shuffle_width(spark)).groupBy("bucket", "f").applyInArrow(_seeds, SEEDS), "passage-windows")
    seeds = stored(hits.where("doc_id <> partner").groupBy("doc_id", "partner").agg(seed_list()).where(F.size(F.array_distinct("seeds.f")) >= AGREE), "passage-seeds")
    found = _verified(seeds, d)
    discard(seeds)
    more = _others(hits, d, found)
    again = _verified(more, d)
    discard(more)
    return found.unionByName(again)


#: Texts that meet one partner's in a task.
SHARE = 200


def _verified(seeds: DataFrame, docs: DataFrame) -> DataFrame:
    """(stored) The passages that seeds (doc_id, partner, seeds) between docs (doc_id, th, text) lead to, as FOUND. A partner of many documents is dealt out over shares of them."""
    many = stored(seeds.groupBy("partner").agg(F.count(F.lit(1)).alias("n")).withColumn("shares", F.ceil(F.col("n") / SHARE).cast("int")), "passage-partners")
    # Only texts in a pair are looked at again; they are fetched once.
    ids = stored(seeds.select("doc_id").union(many.select("partner")).distinct(), "passage-ids")
    docs = stored(docs.join(small(ids), "doc_id", "left_semi"), "passage-texts")
    pairs = join_on_key(seeds, many, ["partner"], rows="n").withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int")).select("doc_id", "partner", "share", "seeds")
    other = many.join(docs.select(F.col("doc_id").alias("partner"), F.col("text").alias("other")).hint("merge"), "partner").select("partner", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "other")
    both = pairs.hint("merge").join(docs.select("doc_id", "th", "text"), "doc_id").join(other.hint("merge"), ["partner", "share"]).select("doc_id", "th", "partner", "text", "other", "seeds")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            ids_, ths, partners, texts_, others = (b.column(k).to_pylist() for k in range(5))
            held = b.column(5)
            cut_at, fields = held.offsets.to_numpy(), [held.values.field(c).to_numpy(zero_copy_only=False) for c in ("c", "l", "r", "pc", "pl", "pr")]
            lists = [np.stack([c[x:y] for c in fields], axis=1) for x, y in zip(cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True)]
            for lo in range(0, len(ids_), 32):
                part = range(lo, min(lo + 32, len(ids_)))
                # Pairs come sorted by partner: each of its texts is hashed once.
                known = list(dict.fromkeys(others[k] for k in part))
                place = {t: len(part) + n for n, t in enumerate(known)}
                h, first, starts, ends, _ = hash_words([*(texts_[k] for k in part), *known])
                s = shingle(h, WIDTH)
                at = np.cumsum([0, *[len(texts_[k].encode("utf-8", "surrogatepass")) + 1 for k in part]])
                cut = lambda n: s[first[n] : max(first[n], first[n + 1] - WIDTH + 1)]  # noqa: E731, B023
                for n, k in enumerate(part):
                    a, z = cut(n), cut(place[others[k]])
                    got = passages(z, a, lists[k][(lists[k][:, 2] < len(a)) & (lists[k][:, 5] < len(z))])
                    if got:
                        w = int(first[n])
                        rows.append((ids_[k], ths[k], partners[k], int(first[n + 1]) - w, [{"first": x, "end": y, "a": int(starts[w + x] - at[n]), "b": int(ends[w + y - 1] - at[n]), "partner_first": m, "partner_end": e, "similarity": sim} for x, y, m, e, sim in got]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), SPAN), strict=True)], ["doc_id", "th", "partner", "words", "spans"])

    out = stored(both.mapInArrow(check, FOUND), "passage-found")
    discard(many, ids, docs)
    return out


SPAN = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("partner_first", pa.int32()), ("partner_end", pa.int32()), ("similarity", pa.float64())]))


def passage_report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_passages (resembling an earlier document), n_repeated_words (in them), partners (the earlier documents, sorted), n_followers (later documents whose passages resemble its own).

    Null text and texts under WORDS words have no passages; rows with one doc_id count as one document of that id and keep their rows; a null doc_id has no passages. An empty table gives an empty result; other columns are not looked at.
    """
    found = stored(repeated_passages(docs).drop("th").distinct(), "passages")
    flat = found.select("doc_id", "partner", F.explode("spans").alias("s"))
    words = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("s.first"), F.col("s.end") - 1)))))
    per = flat.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_passages"), words.cast("long").alias("n_repeated_words"), F.array_sort(F.collect_set("partner")).alias("partners"))
    follow = found.groupBy(F.col("partner").alias("doc_id")).agg(F.count_distinct("doc_id").alias("n_followers"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id")).join(per, "doc_id", "left").join(follow, "doc_id", "left").select("doc_id", zero("n_passages"), zero("n_repeated_words"), F.coalesce("partners", F.array().cast("array<long>")).alias("partners"), zero("n_followers"))


def remove_passages(docs: DataFrame) -> DataFrame:
    """docs (all columns) without the passages that resemble an earlier document's, in text; documents of which no word is left go.

    The earliest occurrence stays. Passages are cut from their first word to the next word after them. n_chars, where there is such a column, follows the text. Rows without passages stay as they are.
    """
    i, h, c = (fresh(docs, f"passage_{x}") for x in ("id", "text", "cuts"))
    found = repeated_passages(docs).select("doc_id", "th", F.explode("spans").alias("s")).groupBy(F.col("doc_id").alias(i), F.col("th").alias(h)).agg(F.collect_set(F.struct("s.a", "s.b")).alias(c))
    marked = docs.join(small(stored(found, "passage-cuts")), (docs["doc_id"].cast("long") == F.col(i)) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col(h)), "left").drop(i, h)
    cols = docs.columns
    at = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cuts = b.column(at).to_pylist(), b.column(len(cols)).to_pylist()
            keep = []
            for i, (t, cs) in enumerate(zip(texts, cuts, strict=True)):
                if cs:
                    raw = t.encode("utf-8", "surrogatepass")
                    out, last = [], 0
                    for x, y in sorted((c["a"], c["b"]) for c in cs):
                        if x > last:
                            out.append(raw[last:x])
                        if y > last:
                            last = y
                            while last < len(raw) and raw[last] in b" \t\n\x0b\x0c\r":
                                last += 1
                    out.append(raw[last:])
                    texts[i] = b"".join(out).decode("utf-8", "surrogatepass")
                    if not texts[i].strip():
                        continue
                keep.append(i)
            arrays = [b.column(k) for k in range(len(cols))]
            arrays[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, cols).take(pa.array(keep, pa.int64()))

    out = marked.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in cols else out
