"""The semantic cache as keyed state of a stream: entries lie in the buckets that lookups ask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.vector_search import lsh_buckets
from .stateful import rocksdb

#: Events. With a query_id it is a lookup; else an entry, or without results the removal of one, under the embedding it was stored with.
EVENT = "ts timestamp, query_id long, key long, embedding array<float>, results string, expires_at timestamp"
HIT = "query_id long, key long, score double, results string"


class _Bucket(StatefulProcessor):
    """The entries of one (table, bucket); each lookup gets the best live one of them."""

    def __init__(self, dim: int, threshold: float, keep: int | None):
        self.dim, self.threshold, self.keep = dim, threshold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key long", "embedding array<float>, results string, expires long", self.keep and self.keep * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        g = pd.concat(list(rows))
        g = g.sort_values(["ts", "asks"], kind="stable")
        ts, until = (g[c].astype("datetime64[us]").astype("int64").to_numpy() for c in ("ts", "expires_at"))
        never = g["expires_at"].isna().to_numpy()
        held = {int(k[0]): (np.asarray(v[0], dtype=float), v[1], int(v[2])) for k, v in self.entries.iterator()}
        out: list[tuple] = []
        table: tuple[np.ndarray, ...] | None = None
        for i, (asks, name, vector, results) in enumerate(zip(g["asks"], g["id"].tolist(), g["embedding"], g["results"], strict=True)):
            usable = vector is not None and len(vector) == self.dim and np.isfinite(v := np.asarray(vector, dtype=float)).all() and v.any()
            if asks:
                if table is None:
                    m = np.stack([x[0] for x in held.values()]) if held else np.zeros((0, self.dim))
                    table = np.array(list(held), dtype=np.int64), m / np.linalg.norm(m, axis=1, keepdims=True), np.array([x[2] for x in held.values()], dtype=np.int64)
                if usable and len(table[0]):
                    names, units, ends = table
                    score = np.where(ends > ts[i], units @ (v / np.linalg.norm(v)), -2.0)
                    best = np.lexsort((names, np.round(score, 12)))[-1]
                    if score[best] >= self.threshold:
                        out.append((name, int(names[best]), float(score[best]), held[int(names[best])][1]))
            else:
                table = None
                if usable and isinstance(results, str) and not never[i]:
                    held[name] = (v, results, int(until[i]))
                    self.entries.updateValue((name,), ([float(x) for x in vector], results, int(until[i])))
                elif name in held:
                    del held[name]
                    self.entries.removeKey((name,))
        yield pd.DataFrame(out, columns=["query_id", "key", "score", "results"]).astype({"query_id": "int64", "key": "int64", "score": "float64"})

    def close(self) -> None:
        pass


def bucket_hits(events: DataFrame, dim: int, threshold: float = 0.95, keep: int | None = 3600, **options: int) -> DataFrame:
    """Stream of (query_id, key, score, results): the best entry of each bucket that a lookup falls into, at or over threshold and not expired at the lookup's ts.

    Events of a micro-batch count in the order of ts, entries before lookups of the same ts. A key again under the same embedding replaces its entry, one without results or expires_at removes it; under another embedding both stay. Null, zero or non-finite vectors and those of another length are no entries and find none; events without a key and a query_id are left out. The state forgets an entry `keep` seconds after it was stored, for which batches follow each other without end, also under availableNow; with None it keeps all and a stream ends with its input. options are those of lsh_buckets.
    """
    # One id without nulls, as pandas turns a column of longs and nulls into doubles.
    e = events.withColumn("id", F.coalesce("query_id", "key")).where("id is not null").withColumn("b", F.explode(lsh_buckets(F.col("embedding"), dim, **options)))
    e = e.select("b.table", "b.bucket", "ts", F.col("query_id").isNotNull().alias("asks"), "id", "embedding", "results", "expires_at")
    return e.groupBy("table", "bucket").transformWithStateInPandas(_Bucket(dim, threshold, keep), HIT, "Append", "ProcessingTime" if keep else "None")


def best_hits(hits: DataFrame) -> DataFrame:
    """The best of each lookup's bucket hits; equal scores (to 12 digits) go to the greater key."""
    top = hits.groupBy("query_id").agg(F.max_by(F.struct("key", "score", "results"), F.struct(F.round("score", 12), F.col("key"))).alias("x"))
    return top.select("query_id", "x.key", "x.score", "x.results")


def answers(events: DataFrame, path: str, dim: int, threshold: float = 0.95, keep: int | None = 3600, **options: int) -> DataStreamWriter:
    """A writer of each micro-batch's best hits as Parquet below path, a folder a batch, which a batch that runs again replaces; a lookup without a row there missed. Set a checkpointLocation and a trigger, and start it."""
    rocksdb(events.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        best_hits(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return bucket_hits(events, dim, threshold, keep, **options).writeStream.foreachBatch(write)
