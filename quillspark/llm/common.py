"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of one Arrow batch sent to a Python worker; texts are long, so few rows are many bytes.
BATCH_ROWS = 512


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, so a Python worker's memory doesn't follow the text length."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # The bound on input alone: with one on output too, grouped functions lose their columns on large results (4.1.2).
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception as e:  # older releases don't know the setting
        if "CANNOT_MODIFY" not in str(e) and "UNKNOWN" not in str(e).upper():
            raise


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where unset, a temporary one in local mode, as in tests, and an error elsewhere."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    found = sc._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def collected(spark: SparkSession) -> None:
    """Spark removes shuffle files when the driver's JVM has collected what refers to them; else they'd pile up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
    """df written as Parquet under the shared checkpoint folder and read again; with tidy, the shuffles that led to it may go at once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    del df
    if tidy:
        collected(spark)
    out = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote, once nothing reads them any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that join_on_key broadcasts at most; no other key has over 1/HOT_KEYS of the rows.
HOT_KEYS = 1000


def join_on_key(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: str | None = None) -> DataFrame:
    """left joined to right, which has one row a key (columns on, not null), and may have any share of its rows under one key.

    Keys with over 1/HOT_KEYS of left's rows are at most HOT_KEYS, so their rows of right are broadcast; all others are shuffled. how: inner or left_semi. rows: the column of right with left's rows of the key, if there is one.
    """
    n = left.count()
    many = right.where(F.col(rows) > n / HOT_KEYS) if rows else left.groupBy(*on).count().where(F.col("count") > n / HOT_KEYS)
    many = many.select(*on)
    hot = [tuple(r) for r in many.collect()]
    if not hot:
        return left.join(right.hint("merge"), on, how)
    keys = left.sparkSession.createDataFrame(hot, many.schema)
    few = right.join(F.broadcast(keys), on, "left_semi")
    rest = left.join(F.broadcast(keys), on, "left_anti").join(right.hint("merge"), on, how)
    return rest.unionByName(left.join(F.broadcast(few), on, how))


#: Rows of ids (and a few numbers each) that a side may have at most to be broadcast; larger sides are shuffled.
SMALL = 250_000


def small(df: DataFrame) -> DataFrame:
    """df (a stored table) marked for a broadcast join if it has at most SMALL rows, else for a merge join."""
    return F.broadcast(df) if df.count() <= SMALL else df.hint("merge")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str, modulus: int, rest: int = 2) -> F.Column:
    """crc32 of the id's decimal text, modulo modulus, is rest (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_batches(batches: Iterator[pa.RecordBatch], max_chars: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of (id, text) batches, cut so that each holds about max_chars; null text is empty."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
        lo, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= max_chars:
                yield ids[lo : i + 1], texts[lo : i + 1]
                lo, size = i + 1, 0
        if lo < len(texts):
            yield ids[lo:], texts[lo:]
