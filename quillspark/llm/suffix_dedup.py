"""Exact removal of repeated byte strings, by a sparse suffix array sorted deep-shallow.

A string of `length` bytes holds a minimizer: the least-hashed run of ANCHOR bytes in it, the leftmost of equals. Equal strings have it at the same place, so it is enough to sort the suffixes (and, backwards, the prefixes) at minimizers, one group for each run of ANCHOR bytes. In a group two occurrences whose common context reaches L bytes to the left and R to the right share a string of `length` bytes if L + R >= length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_on_key, stored
from .words import _powers, mix

#: Bytes that decide a group; windows of length - ANCHOR + 1 starts have one minimizer.
ANCHOR = 160
#: Depth beyond the common start up to which multikey quicksort sorts.
SHALLOW = 32
#: Distinct contexts of a group that are sorted in one task; larger groups are split by the strings themselves.
GROUP = 256

ANCHORS = "doc_id long, th long, key long, frag long, lo int, o int, n int"


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least start."""
    top = min(len(a), len(b))
    step = 16
    while start < top:
        stop = min(top, start + step)
        if a[start:stop] == b[start:stop]:
            start, step = stop, step * 2
        elif stop - start == 1:
            return start
        else:
            step = max(1, (stop - start) // 2)
            if step == stop - start:
                return start
    return top


class BlindTrie:
    """Orders strings of a long common prefix: descent looks at branching bytes only, one comparison with the leaf found places the string."""

    def __init__(self, strings: list[bytes], first: int):
        self.s = strings
        self.root = self._leaf(first)

    def _leaf(self, i: int) -> list:
        """Depth, children by byte (-1: the string ends), one string below, the strings equal to it."""
        return [len(self.s[i]), {}, i, [i]]

    def insert(self, i: int, known: int) -> None:
        s = self.s[i]
        node = self.root
        path = [node]
        while node[1]:
            below = node[1].get(s[node[0]] if node[0] < len(s) else -1)
            if below is None:
                break
            node = below
            path.append(node)
        other = self.s[node[2]]
        depth = common_prefix(s, other, known)
        if not node[1] and depth == len(s) == len(other):
            node[3].append(i)
            return
        spot = next(p for p in path if p[0] >= depth)
        c = s[depth] if depth < len(s) else -1
        if spot[1] and spot[0] == depth:
            spot[1][c] = self._leaf(i)
            return
        branch = self.s[spot[2]]
        d = branch[depth] if depth < len(branch) else -1
        spot[:] = [depth, {c: self._leaf(i), d: spot[:]}, spot[2], []]

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            out += node[3]
        return out


def deep_shallow(strings: list[bytes], start: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, common prefixes of neighbours in it) of strings whose first start bytes are equal."""
    order: list[int] = []
    limit = start + shallow
    todo: list[tuple[list[int], int]] = [(list(range(len(strings))), start)]
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            order += group
        elif depth >= limit:
            trie = BlindTrie(strings, group[0])
            for i in group[1:]:
                trie.insert(i, depth)
            order += trie.order()
        else:  # multikey quicksort, eight bytes at a time
            part = [strings[i][depth : depth + 8] for i in group]
            pivot = part[len(part) // 2]
            less = [i for i, p in zip(group, part, strict=True) if p < pivot]
            same = [i for i, p in zip(group, part, strict=True) if p == pivot]
            more = [i for i, p in zip(group, part, strict=True) if p > pivot]
            if more:
                todo.append((more, depth))
            if len(pivot) < 8:
                todo += [([i], depth) for i in reversed(same)]
            else:
                todo.append((same, depth + 8))
            if less:
                todo.append((less, depth))
    return order, [common_prefix(strings[a], strings[b], start) for a, b in zip(order, order[1:], strict=False)]


def pairwise(order: list[int], lcp: list[int]) -> np.ndarray:
    """Common prefix of every two strings: the least one between their places."""
    n = len(order)
    out = np.zeros((n, n), dtype=np.int32)
    if n > 1:
        l = np.array(lcp, dtype=np.int32)
        at = np.array(order)
        for i in range(n - 1):
            m = np.minimum.accumulate(l[i:])
            out[at[i], at[i + 1 :]] = m
            out[at[i + 1 :], at[i]] = m
    return out


def anchors_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, key, fragment hash, first start, anchor - first start, starts) of each minimizer's run of window starts."""
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    n, k = len(buf), ANCHOR
    w = length - k + 1
    empty = np.zeros(0, dtype=np.int64)
    if n < length:
        return empty, empty, empty, empty, empty, empty
    pw, inv = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[:n], out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * inv[: n - k + 1])
    bits = np.uint64(max(20, n.bit_length()))
    code = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    pad = -len(code) % w
    grid = np.concatenate((code, np.full(pad, ~np.uint64(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = np.concatenate([np.arange(e - s, e - length + 1) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True) if s >= length] or [empty])
    if not len(starts):
        return empty, empty, empty, empty, empty, empty
    at = (np.minimum(behind[starts], ahead[starts + w - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    lo = starts[new]
    hi = starts[np.concatenate((new[1:], [len(starts)])) - 1]
    a = at[new]
    doc = np.searchsorted(ends, lo, side="right")
    o, count = a - lo, hi - lo + 1
    frag = mix((sums[hi + length] - sums[lo]) * inv[lo] ^ (o.astype(np.uint64) << np.uint64(40)) ^ (count.astype(np.uint64) << np.uint64(52)))
    return doc, h[a].view(np.int64), frag.view(np.int64), lo - (ends - sizes)[doc], o, count


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), [_raw(t) for t in b.column(2).to_pylist()]
            nulls = b.column(0).is_null().to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 1 << 20):
                    size += len(texts[hi])
                    hi += 1
                doc, key, frag, first, o, count = anchors_of(texts[lo:hi], length)
                if len(doc):
                    own = np.nan_to_num(ids[lo:hi]).astype(np.int64)[doc]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=nulls[lo:hi][doc]), pa.array(th[lo:hi][doc]), pa.array(key), pa.array(frag), pa.array(first.astype(np.int32)), pa.array(o.astype(np.int32)), pa.array(count.astype(np.int32))], ["doc_id", "th", "key", "frag", "lo", "o", "n"])
                lo = hi

    return docs.select("doc_id", "th", "text").mapInArrow(run, ANCHORS)


def _contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted with the bytes of each fragment."""
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "frag", "lo", "o", "n", "times", "size")).alias("w"))
    both = docs.alias("d").join(lists.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.th") == F.col("l.th"))).select("d.doc_id", "d.th", "d.text", "l.w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = _raw(b.column(2)[i].as_py())
                w = b.column(3)[i].as_py()
                m = len(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[i].as_py()] * m, pa.int64()), pa.array([b.column(1)[i].as_py()] * m, pa.int64()), *(pa.array([x[c] for x in w], t) for c, t in (("key", pa.int64()), ("frag", pa.int64()), ("lo", pa.int32()), ("o", pa.int32()), ("n", pa.int32()), ("times", pa.int64()), ("size", pa.int64()))), pa.array([raw[x["lo"] : x["lo"] + x["n"] - 1 + length] for x in w], pa.binary())],
                    ["doc_id", "th", "key", "frag", "lo", "o", "n", "times", "size", "content"],
                )

    return both.mapInArrow(run, "doc_id long, th long, key long, frag long, lo int, o int, n int, times long, size long, content binary")


SPANS = "doc_id long, th long, a int, b int"


def _sorted_spans(contents: DataFrame, length: int) -> DataFrame:
    """Spans of the fragments that occur once, from the contexts they share with others of their group."""

    def run(t: pa.Table) -> pa.Table:
        content, o, lo, times = t["content"].to_pylist(), t["o"].to_numpy(), t["lo"].to_numpy(), t["times"].to_numpy()
        right = [c[x:] for c, x in zip(content, o.tolist(), strict=True)]
        left = [c[:x][::-1] for c, x in zip(content, o.tolist(), strict=True)]
        r = pairwise(*deep_shallow(right, ANCHOR))
        l = pairwise(*deep_shallow(left))
        share = l + r >= length
        np.fill_diagonal(share, False)
        some = share.any(axis=1) & (times == 1)
        begin = lo + o - np.where(share, l, 0).max(axis=1)
        end = lo + o + np.where(share, r, 0).max(axis=1)
        at = np.flatnonzero(some)
        return pa.table({"doc_id": t["doc_id"].take(pa.array(at)), "th": t["th"].take(pa.array(at)), "a": pa.array(begin[at].astype(np.int32)), "b": pa.array(end[at].astype(np.int32))})

    return contents.select("key", "doc_id", "th", "lo", "o", "times", "content").groupBy("key").applyInArrow(run, SPANS)


#: Distinct contexts of a large group whose strings meet in one task.
SHARE = 4096


def _split_spans(contents: DataFrame, length: int) -> DataFrame:
    """The same for large groups, of any size: the strings of each fragment, as hashes, are dealt over enough shares that one holds those of about SHARE fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pw, inv = _powers(4096)
        for b in batches:
            for i in range(b.num_rows):
                c = np.frombuffer(b.column(8)[i].as_py(), dtype=np.uint8)
                n = b.column(6)[i].as_py()
                s = np.zeros(len(c) + 1, dtype=np.uint64)
                np.cumsum((c.astype(np.uint64) + np.uint64(1)) * pw[: len(c)], out=s[1:])
                h = mix((s[length : length + n] - s[:n]) * inv[:n])
                share = (h % np.uint64(-(-b.column(9)[i].as_py() // SHARE))).astype(np.int64)
                at = [np.flatnonzero(share == k) for k in np.unique(share)]
                m = len(at)
                lo = b.column(4)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([b.column(k)[i].as_py()] * m, pa.int64()) for k in (0, 1, 2, 3, 7)), pa.array([int(share[x[0]]) for x in at], pa.int64()), pa.array([h[x].tobytes() for x in at], pa.binary()), pa.array([(lo + x).astype("<i4").tobytes() for x in at], pa.binary())],
                    ["doc_id", "th", "key", "frag", "times", "share", "strings", "places"],
                )

    def meet(t: pa.Table) -> pa.Table:
        h = [np.frombuffer(x, dtype="<u8") for x in t["strings"].to_pylist()]
        p = np.concatenate([np.frombuffer(x, dtype="<i4") for x in t["places"].to_pylist()])
        own = np.repeat(np.arange(len(h)), [len(x) for x in h])
        _, at, count = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        dup = count[at] > 1
        lo, hi = np.full(len(h), np.iinfo(np.int32).max), np.full(len(h), -1)
        np.minimum.at(lo, own[dup], p[dup])
        np.maximum.at(hi, own[dup], p[dup])
        keep = np.flatnonzero((hi >= 0) & (t["times"].to_numpy() == 1))
        return pa.table([t[c].take(pa.array(keep)) for c in ("doc_id", "th", "key", "frag")] + [pa.array(lo[keep].astype(np.int32)), pa.array((hi[keep] + length).astype(np.int32))], names=["doc_id", "th", "key", "frag", "a", "b"])

    cols = contents.select("doc_id", "th", "key", "frag", "lo", "o", "n", "times", "content", "size")
    w = cols.mapInArrow(run, "doc_id long, th long, key long, frag long, times long, share long, strings binary, places binary")
    hit = w.groupBy("key", "share").applyInArrow(meet, "doc_id long, th long, key long, frag long, a int, b int")
    return hit.groupBy("doc_id", "th", "key", "frag").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("doc_id", "th", "a", "b")


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, a, b): byte spans covered by strings of `length` bytes that start anywhere else too; spans of a document may overlap. docs: doc_id, th (hash of the text), text."""
    anchors = stored(_anchor_rows(docs, length), "anchors")
    again = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    near = stored(join_on_key(anchors, again, ["key"], rows="c").drop("c"), "anchors-again")
    discard(anchors)
    distinct = near.groupBy("key", "frag").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "th", "lo", "o", "n")).alias("s"))
    distinct = stored(distinct, "fragments")
    whole = join_on_key(near, distinct.where("times > 1").select("key", "frag", "times"), ["key", "frag"], rows="times").select("doc_id", "th", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + length).cast("int").alias("b"))
    open_ = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("times").alias("least")).where("size > 1 and least = 1").select("key", "size")
    wanted = join_on_key(distinct, open_, ["key"], rows="size").select("s.*", "key", "frag", "times", "size")
    contents = stored(_contents(docs, wanted, length), "contexts")
    spans = whole.unionByName(_sorted_spans(contents.where(F.col("size") <= GROUP), length)).unionByName(_split_spans(contents.where(F.col("size") > GROUP), length))
    out = stored(spans, "spans")
    discard(near, distinct, contents)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, texts: bool = False) -> DataFrame:
    """Each document without the bytes covered by `length`-byte strings that also start anywhere else (this document included).

    Strings are judged on the input; occurrences may overlap. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (lowercase hex of the remaining bytes); with texts also kept (the remaining bytes).
    Null text counts as empty; texts under `length` bytes stay whole. A row that occurs twice repeats itself, so its strings go in both; a null doc_id is a document like others. An empty table gives an empty result; other columns are not looked at.
    One shuffle of minimizers finds the groups, documents are joined twice. A fragment that occurs as a whole elsewhere needs no sorting; groups with many different contexts are split by the strings' hashes, so no task gets a hot group.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(d, length).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    both = d.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th")), "left").select("d.doc_id", "d.text", "s.spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, sp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = _raw(text)
                kept, at, removed, runs, last = [], 0, 0, 0, -1
                for s in sorted((x["a"], x["b"]) for x in sp or ()):
                    if s[0] > last:
                        kept.append(raw[max(last, 0) : s[0]])
                        runs += 1
                        removed += s[1] - s[0]
                        last = s[1]
                    elif s[1] > last:
                        removed += s[1] - last
                        last = s[1]
                kept.append(raw[max(last, 0) :])
                left = b"".join(kept)
                rows.append((i, len(raw), removed, runs, hashlib.sha256(left).hexdigest(), left)[: 5 + texts])
            if rows:
                types = [pa.int64()] * 4 + [pa.string(), pa.binary()][: 1 + texts]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return both.mapInArrow(run, schema)
