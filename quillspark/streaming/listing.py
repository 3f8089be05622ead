"""A folder as a stream: each micro-batch is a listing made in tasks, changes come from state kept by path."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..sources.loader import SUFFIXES
from ..sources.store import Store
from .stateful import DEBOUNCE, rocksdb

ROW = "path string, mtime long, size long, tick long"
CHANGE = "path string, change string, mtime long"


def _source() -> type[DataSource]:
    """The source's class. It is made here so that it is sent to workers by value and needs nothing but pyarrow there."""

    class Share(InputPartition):
        def __init__(self, number: int, tick: int):
            super().__init__(number)
            self.number, self.tick = number, tick

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict[str, str]):
            self.path, self.suffixes, self.shares = options["path"], tuple(options["suffixes"].split(",")), int(options["shares"])

        def initialOffset(self) -> dict:  # noqa: N802
            return {"tick": 0}

        def latestOffset(self) -> dict:  # noqa: N802
            return {"tick": time.time_ns() // 1000}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [Share(i, end["tick"]) for i in range(self.shares)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            """The files of the share: of the folder's own files and of its subfolders, those whose names' checksums fall to it."""
            from urllib.parse import urlsplit
            from zlib import crc32

            from pyarrow.fs import FileSelector, FileSystem, FileType

            url = urlsplit(self.path)
            fs, base = FileSystem.from_uri(self.path)
            prefix = "file:" if url.scheme in ("", "file") else f"{url.scheme}://{url.netloc}"
            for top in fs.get_file_info(FileSelector(base, allow_not_found=True)):
                if crc32(top.base_name.encode()) % self.shares != partition.number:
                    continue
                below = fs.get_file_info(FileSelector(top.path, recursive=True, allow_not_found=True)) if top.type == FileType.Directory else [top]
                for f in below:
                    if f.type == FileType.File and f.base_name.lower().endswith(self.suffixes):
                        yield prefix + f.path, f.mtime_ns // 1000, f.size, partition.tick

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return "quillspark_listing"

        def schema(self) -> str:
            return "path string, mtime long, size long, tick long"

        def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
            return Reader(self.options)

    return Listing


def listings(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, shares: int = 8) -> DataFrame:
    """Stream of (path, mtime in microseconds, size, tick): in each micro-batch every watched file of the folder once, listed in `shares` tasks. path is an absolute one or a URL that pyarrow opens; an absent folder is an empty one."""
    spark.dataSource.register(_source())
    return spark.readStream.format("quillspark_listing").option("path", path).option("suffixes", ",".join(suffixes)).option("shares", shares).load()


class _File(StatefulProcessor):
    """One path: what was last reported of it and when. A listing that lacks it lets the timer set by the one before run out."""

    def __init__(self, gap: float):
        self.gap = int(gap * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "mtime long, size long, at long")

    def _timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        last = pd.concat(list(rows)).sort_values("tick").iloc[-1]
        seen = int(last["mtime"]), int(last["size"])
        change = None
        if not self.told.exists():
            change = "created"
        else:
            mtime, size, at = self.told.get()
            if seen != (mtime, size) and now - at >= self.gap:
                change = "modified"
        if change:
            self.told.update((*seen, now))
        self._timer(now + 1)
        yield pd.DataFrame([(key[0], change, seen[0])] if change else [], columns=["path", "change", "mtime"]).astype({"mtime": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        mtime, _, at = self.told.get()
        gone = now - at >= self.gap
        if gone:
            self.told.clear()
        else:
            self._timer(at + self.gap)
        yield pd.DataFrame([(key[0], "deleted", mtime)] if gone else [], columns=["path", "change", "mtime"]).astype({"mtime": "int64"})

    def close(self) -> None:
        pass


def changes(files: DataFrame, gap: float = DEBOUNCE) -> DataFrame:
    """Stream of (path, change, mtime): created, modified and deleted files of a stream of listings.

    What comes within the gap of a path's last report waits; the first listing after the gap reports what it has come to. A file written again within the gap is modified then, one that came back is none.
    """
    rocksdb(files.sparkSession)
    return files.groupBy("path").transformWithStateInPandas(_File(gap), CHANGE, "Append", "ProcessingTime")


def index_changes(found: DataFrame, store: Store) -> DataStreamWriter:
    """A writer that takes each micro-batch's changes into the store as one commit. Only changed paths come to the driver. A batch that runs again gives the same rows, as rows of a created path are replaced, too. Set a checkpointLocation and a trigger, and start it."""

    def take(batch: DataFrame, _: int) -> None:
        store.sync([(r["path"], "deleted" if r["change"] == "deleted" else "modified") for r in batch.collect()])

    return found.writeStream.foreachBatch(take)
