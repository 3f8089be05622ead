"""Stateful operators: debouncing, rate limiting, file watching, windows. Each runs as a batch and, where it makes sense, on a stream."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.loader import SUFFIXES
from ..sources.scratch import stored
from ..sources.store import snapshot_diff

#: Seconds of the debounce; requests and seconds of a limiter's window; requests a minute of one address.
DEBOUNCE, LIMIT, WINDOW, IP_LIMIT = 2.0, 100, 60.0, 30


def accepted(times: list[float], gap: float = DEBOUNCE) -> list[bool]:
    """Leading-edge debounce of sorted times: each event at least gap after the last accepted one."""
    out, last = [], None
    for t in times:
        ok = last is None or t - last >= gap
        last = t if ok else last
        out.append(ok)
    return out


def limited(times: list[float], limit: int = LIMIT, window: float = WINDOW, counts: tuple[float, int] | None = None) -> tuple[list[tuple[bool, int, float]], tuple[float, int] | None]:
    """(allowed, remaining, reset) of sorted request times in windows that begin with a request, and the state after them."""
    out, state = [], counts
    for t in times:
        if state is None or t - state[0] >= window:
            state = (t, 1)
            out.append((True, limit - 1, t + window))
        elif state[1] >= limit:
            out.append((False, 0, state[0] + window))
        else:
            state = (state[0], state[1] + 1)
            out.append((True, limit - state[1], state[0] + window))
    return out, state


class Limiter:
    """limited() for the callers of a service, one window for each identifier (kept by its digest only)."""

    def __init__(self, limit: int = LIMIT, window: float = WINDOW, now: Callable[[], float] = time.time):
        self.limit, self.window, self.now = limit, window, now
        self._windows: dict[str, tuple[float, int]] = {}

    @staticmethod
    def key(identifier: str) -> str:
        return hashlib.md5(identifier.encode()).hexdigest()

    def check(self, identifier: str, limit: int | None = None) -> tuple[bool, dict[str, int]]:
        """Whether this request may pass; limit, remaining, reset and, if not, retry_after."""
        key, at, most = self.key(identifier), self.now(), limit or self.limit
        [(ok, left, end)], self._windows[key] = limited([at], most, self.window, self._windows.get(key))
        return ok, {"limit": most, "remaining": left, "reset": int(end)} | ({} if ok else {"retry_after": int(end - at)})

    def reset(self, identifier: str) -> None:
        self._windows.pop(self.key(identifier), None)


def rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, which keyed state with timers and times to live needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _seconds(s: pd.Series) -> list[float]:
    return (s.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def debounce(events: DataFrame, key: str = "path", ts: str = "ts", gap: float = DEBOUNCE) -> DataFrame:
    """The events accepted for each key, all columns; order by time, equal times in row order."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(ts, kind="stable")
        return g[accepted(_seconds(g[ts]), gap)]

    return events.groupBy(key).applyInPandas(run, events.schema)


def rate_limit(requests: DataFrame, key: str = "key", ts: str = "ts", limit: int = LIMIT, window: float = WINDOW, tie: str | None = None) -> DataFrame:
    """requests with allowed, remaining and retry_after (seconds, 0 if allowed)."""
    schema = StructType([*requests.schema.fields, *StructType.fromDDL("allowed boolean, remaining int, retry_after int").fields])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([ts, tie] if tie else ts, kind="stable")
        times = _seconds(g[ts])
        got, _ = limited(times, limit, window)
        return g.assign(allowed=[a for a, _, _ in got], remaining=[r for _, r, _ in got], retry_after=[0 if a else int(e - t) for (a, _, e), t in zip(got, times, strict=True)])

    return requests.groupBy(key).applyInPandas(run, schema)


def rate_limit_by_ip(requests: DataFrame, key: str = "ip", ts: str = "ts", limit: int = IP_LIMIT) -> DataFrame:
    return rate_limit(requests, key, ts, limit)


class _Debounce(StatefulProcessor):
    def __init__(self, ts: str, gap: float):
        self.ts, self.gap = ts, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] / 1e6 if self.last.exists() else None
        for g in rows:
            g = g.sort_values(self.ts, kind="stable")
            keep = []
            for t in _seconds(g[self.ts]):
                ok = last is None or t - last >= self.gap
                last = t if ok else last
                keep.append(ok)
            yield g[keep]
        if last is not None:
            self.last.update((int(last * 1e6),))

    def close(self) -> None:
        pass


def debounce_stream(events: DataFrame, key: str = "path", ts: str = "ts", gap: float = DEBOUNCE) -> DataFrame:
    """debounce() on a stream, the last accepted time of each key kept as state (needs the RocksDB state store)."""
    return events.groupBy(key).transformWithStateInPandas(_Debounce(ts, gap), events.schema, "Append", "None")


class _Limiter(StatefulProcessor):
    def __init__(self, ts: str, limit: int, window: float):
        self.ts, self.limit, self.window = ts, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", StructType([StructField("us", LongType()), StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = (self.state.get()[0] / 1e6, self.state.get()[1]) if self.state.exists() else None
        for g in rows:
            g = g.sort_values(self.ts, kind="stable")
            times = _seconds(g[self.ts])
            got, state = limited(times, self.limit, self.window, state)
            yield g.assign(allowed=[a for a, _, _ in got], remaining=[r for _, r, _ in got], retry_after=[0 if a else int(e - t) for (a, _, e), t in zip(got, times, strict=True)])
        if state is not None:
            self.state.update((int(state[0] * 1e6), int(state[1])))

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, key: str = "key", ts: str = "ts", limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    schema = StructType([*requests.schema.fields, *StructType.fromDDL("allowed boolean, remaining int, retry_after int").fields])
    return requests.groupBy(key).transformWithStateInPandas(_Limiter(ts, limit, window), schema, "Append", "None")


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, mtime, size) of the watched files; directories are not files and have no row."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


class FileWatcher:
    """Changes of a folder between polls: created, modified and deleted files, debounced, pending until taken."""

    def __init__(self, spark: SparkSession, path: str, on_change: Callable[[list[tuple[str, str]]], None] | None = None, suffixes: tuple[str, ...] = SUFFIXES, gap: float = DEBOUNCE):
        self.spark, self.path, self.suffixes, self.gap = spark, path, suffixes, gap
        self.on_change = on_change
        self._last: DataFrame | None = None
        self._seen: dict[str, float] = {}
        self._pending: list[tuple[str, str]] = []

    def start(self) -> FileWatcher:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
        self._last = self._snapshot()
        return self

    def stop(self) -> None:
        self._last = None

    def is_running(self) -> bool:
        return self._last is not None

    def _snapshot(self) -> DataFrame:
        return stored(listing(self.spark, self.path, self.suffixes), "listing")

    def poll(self, now: float | None = None) -> list[tuple[str, str]]:
        """(path, change) since what was last reported of each path; what comes within the gap of the path's last report waits, and the first poll after the gap reports what it has come to.

        The state is a stored table of files as last reported; only paths that changed come to the driver.
        """
        if self._last is None:
            raise RuntimeError("the watcher is not running")
        at = time.time() if now is None else now
        new = self._snapshot()
        found = [(r["path"], r["change"]) for r in snapshot_diff(self._last, new, compare=("mtime", "size")).orderBy("path").collect()]
        self._seen = {p: t for p, t in self._seen.items() if at - t < self.gap}
        out = [(path, change) for path, change in found if path not in self._seen]
        if not out:
            return out
        if self.on_change:
            self.on_change(out)  # if it fails, the next poll reports them again
        self._seen |= {path: at for path, _ in out}
        paths = self.spark.createDataFrame([(p,) for p, _ in out], "path string")
        self._last = stored(self._last.join(paths, "path", "left_anti").unionByName(new.join(paths, "path", "left_semi").select(*self._last.columns)), "listing")
        self._pending += out
        return out

    def pending(self) -> list[tuple[str, str]]:
        """Pending changes, drained."""
        out, self._pending = self._pending, []
        return out

    def __enter__(self) -> FileWatcher:
        return self.start()

    def __exit__(self, *exc: object) -> None:
        self.stop()


def auto_index(spark: SparkSession, path: str, store: object) -> FileWatcher:
    """A watcher that takes the changed files, and only these, into the store."""
    return FileWatcher(spark, path, store.sync)


def new_files_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream of (path, mtime, content) of files as they appear."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(path)


# Event-time windows.


def tumbling(events: DataFrame, size: str, *keys: str, ts: str = "ts", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Event counts and value sums by window (and keys); late sets the watermark."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, *keys: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
