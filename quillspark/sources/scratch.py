"""Tables kept between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where unset, a temporary one in local mode, as in tests, and an error elsewhere."""
    sc = spark.sparkContext
    state = sc._jsc.sc().getCheckpointDir()
    if not state.isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        state = sc._jsc.sc().getCheckpointDir()
    return sc.getConf().get("spark.checkpoint.dir") or state.get()


def place(spark: SparkSession, name: str) -> str:
    """A path below that folder that nothing else uses."""
    return f"{folder(spark).rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: computed once, whatever is lost later."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    folder(df.sparkSession)
    return df.checkpoint()
