"""Token-id output: best-fit-decreasing packing of whole documents into rows of fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bytebpe
from .common import text_batches

SCHEMA = "row_id long, n_tokens int, n_segments int, doc_ids array<long>, doc_offsets array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class CapacityTree:
    """Segment tree over free capacities 0..top; finds the open bin with the least capacity that still fits."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(top + 1)]

    def _add(self, capacity: int, by: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, capacity: int, bin_no: int) -> None:
        self.bins[capacity].append(bin_no)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(bin, its capacity) of the tightest bin with capacity >= need, taken out; None if there is none."""
        k = need + self.size
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        capacity = k - self.size
        self._add(capacity, -1)
        return self.bins[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], row_len: int) -> list[list[int]]:
    """Indices of the pieces in each row: longest first, each into the fullest row that takes it. Ties keep the given order."""
    tree = CapacityTree(row_len)
    rows: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            rows.append([i])
            left = row_len - lengths[i]
            tree.put(left, len(rows) - 1)
        else:
            rows[found[0]].append(i)
            tree.put(found[1] - lengths[i], found[0])
    return rows


class CachedEncoder:
    """Ids of texts as little-endian uint16 bytes; words between single spaces are looked up, new ones encoded together.

    A space between two other visible characters always starts a new piece, and so does a single newline between them; any other white space goes the plain way.
    """

    LIMIT = 400_000

    def __init__(self, path: str):
        self.bpe = bytebpe.load(path)
        if len(self.bpe.bytes_of) > 65_536:
            raise ValueError("packed ids are 16 bits wide; this vocabulary needs more")
        self.spaced: dict[str, bytes] = {}
        self.newline = self._raw(self.bpe.encode("\n"))

    @staticmethod
    def _raw(ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u2").tobytes()

    def _whole(self, text: str) -> list[int]:
        """Ids of a text at once; with special strings or very long words in it by halves."""
        if any(x in text for x in self.bpe.special) or max(map(len, text.split()), default=0) > 4096:
            return self.bpe.encode(text)
        return self.bpe._enc.encode_ordinary(text)

    def _learn(self, units: list[str]) -> None:
        if len(self.spaced) > self.LIMIT:
            self.spaced.clear()
        ids = np.asarray(self.bpe._enc.encode_ordinary(" " + " ".join(units)), dtype="<u2")
        at = np.flatnonzero(self.bpe.leads_space[ids])
        if len(at) != len(units):
            for u in units:
                self.spaced[u] = self._raw(self.bpe._enc.encode_ordinary(" " + u))
            return
        raw, ends = ids.tobytes(), [*at[1:].tolist(), len(ids)]
        for u, a, b in zip(units, at.tolist(), ends, strict=True):
            self.spaced[u] = raw[2 * a : 2 * b]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        plain: list[list[list[str]] | None] = []
        fresh: set[str] = set()
        if len(self.spaced) > self.LIMIT:
            self.spaced.clear()
        for t in texts:
            lines = [ln.split(" ") for ln in t.split("\n")]
            flat = [u for ln in lines for u in ln]
            if not all(flat) or any(s in t for s in self.bpe.special) or not t.isprintable() and not t.replace("\n", "").isprintable() or " " in t or "　" in t:
                plain.append(None)
                continue
            plain.append(lines)
            fresh.update(u for u in flat if u not in self.spaced)
        if fresh:
            units = sorted(fresh)
            for i in range(0, len(units), 4096):
                self._learn(units[i : i + 4096])
        out = []
        for t, lines in zip(texts, plain, strict=True):
            if lines is None:
                out.append(self._raw(self._whole(t)))
                continue
            parts = []
            for ln in lines:
                parts.append(self._raw(self.bpe._enc.encode_ordinary(ln[0])) if len(ln) == 1 or ln[0] else b"")
                parts.append(b"".join([self.spaced[u] for u in ln[1:]]))
                parts.append(self.newline)
            out.append(b"".join(parts[:-1]))
        return out


def pack(docs: DataFrame, row_len: int = 2048, tokenizer: str | None = None, end_id: int | None = 50256, block_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of at most row_len token ids that hold every token of every document once.

    Each document is its ids and then end_id (None: nothing, and empty documents vanish). Documents over row_len are split into pieces in order, none dropped; full pieces are rows of their own. The other pieces are packed best-fit-decreasing within blocks of about block_tokens tokens of one partition, so nothing is shuffled and memory is one block.
    input_ids and position_ids are little-endian uint16 of length row_len (padded with end_id or 0, and 0); cu_seqlens has the ends of the segments from 0 on; positions count from 0 in each segment; doc_offsets is the place of the segment's first token in its document.
    Null text counts as empty, repeated rows are packed again, a null id stays null in doc_ids; an empty table gives no rows. Row ids number the rows of a partition, so they depend on the partitioning.
    """
    path = tokenizer or bytebpe.default_path("byte_bpe_50k.json")
    tail = b"" if end_id is None else int(end_id).to_bytes(2, "little")
    pad = end_id or 0

    def row(segments: list[tuple[int | None, int, bytes]], row_id: int) -> tuple:
        lens = [len(s[2]) // 2 for s in segments]
        ends = np.cumsum(lens)
        ids = np.full(row_len, pad, dtype="<u2")
        ids[: ends[-1]] = np.frombuffer(b"".join(s[2] for s in segments), dtype="<u2")
        pos = np.zeros(row_len, dtype="<u2")
        pos[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends - lens, lens)
        return row_id, int(ends[-1]), len(segments), [s[0] for s in segments], [s[1] for s in segments], [0, *ends.tolist()], ids.tobytes(), pos.tobytes()

    types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = CachedEncoder(path)
        next_id = TaskContext.get().partitionId() << 40

        def emit(groups: list[list[tuple[int | None, int, bytes]]]) -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            for lo in range(0, len(groups), 512):
                rows = [row(g, next_id + i) for i, g in enumerate(groups[lo : lo + 512])]
                next_id += len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        waiting: list[tuple[int | None, int, bytes]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            packed = best_fit_decreasing([len(w[2]) // 2 for w in waiting], row_len)
            yield from emit([[waiting[i] for i in g] for g in packed])
            waiting.clear()
            held = 0

        for keys, texts in text_batches(batches):
            full = []
            for key, raw in zip(keys, enc.encode_all(texts), strict=True):
                raw += tail
                for at in range(0, len(raw), 2 * row_len):
                    seg = (key, at // 2, raw[at : at + 2 * row_len])
                    if len(seg[2]) == 2 * row_len:
                        full.append([seg])
                    else:
                        waiting.append(seg)
                        held += len(seg[2]) // 2
            yield from emit(full)
            if held >= block_tokens:
                yield from flush()
        yield from flush()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet: one fixed-length binary id matrix row, its position resets and segment lengths each."""
    packed.write.mode("overwrite").parquet(path)
