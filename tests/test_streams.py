"""Keyed state: the semantic cache and the changes of a folder as streams."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import cache
from quillspark.sources.store import Store
from quillspark.streaming import listing, semantic

T0 = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def entry(ts, key, vector, results="r", until=1000):
    return at(ts), None, key, vector, results, None if until is None else at(until)


def lookup(ts, query, vector):
    return at(ts), query, None, vector, None, None


def test_semantic_cache_of_a_stream(spark, tmp_path):
    """Replaced, expired, removed and unusable entries, ties, and lookups between entries; a second run goes on with the state of the first."""
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    first = [
        entry(0, 1, a, "old"), entry(1, 1, a, "new"), entry(2, 2, a, "tie"), entry(3, 2**60 + 1, b, "short", 10),
        entry(4, 4, None), entry(4, 5, [0.0] * 4), entry(4, 6, [float("nan")] * 4), entry(4, 7, [1.0]), entry(4, 8, a, "no end", None),
        lookup(1, 10, a), lookup(5, 11, a), lookup(5, 12, b), lookup(20, 13, b), lookup(5, 14, None), lookup(5, 15, [0.0] * 4), lookup(0, 16, [1.0, 1.0, 0.0, 0.0]),
    ]
    second = [entry(30, 2, a, None), lookup(29, 20, a), lookup(31, 21, [2.0, 0.0, 0.0, 0.0])]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (first, second):
        spark.createDataFrame(rows, semantic.EVENT).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(semantic.EVENT).parquet(source)
        q = semantic.answers(events, out, 4, keep=None, tables=2, bits=2).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {r["query_id"]: (r["key"], r["results"], round(r["score"], 6)) for r in spark.read.schema(semantic.HIT).parquet(f"{out}/*").collect()}
    assert got == {10: (1, "new", 1.0), 11: (2, "tie", 1.0), 12: (2**60 + 1, "short", 1.0), 20: (2, "tie", 1.0), 21: (1, "new", 1.0)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, [float((i * 7 + j * j) % 11 - 5) + (i % 3) / 50 for j in range(6)]) for i in range(60)]
    rows += [(100 + i, v) for i, v in rows[:10]]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    e = v.select(F.col("doc_id").alias("key"), "embedding", F.col("doc_id").cast("string").alias("results"), F.when(F.col("doc_id") % 4 > 0, F.lit(at(100))).otherwise(F.lit(at(-100))).alias("expires_at"))
    q = v.select(F.col("doc_id").alias("query_id"), "embedding")
    want = cache.semantic_lookup(e, q, 6, 0.9, F.lit(at(0))).select("query_id", "results", F.round("score", 6)).collect()
    events = e.withColumn("ts", F.lit(at(-50))).withColumn("query_id", F.lit(None).cast("long")).unionByName(q.withColumn("ts", F.lit(at(0))), allowMissingColumns=True)
    events.write.parquet(str(tmp_path / "in"))
    stream = semantic.answers(spark.readStream.schema(semantic.EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "out"), 6, 0.9, None)
    assert stream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.schema(semantic.HIT).parquet(f"{tmp_path}/out/*").select("query_id", "results", F.round("score", 6)).collect()
    assert len(want) > 40
    # Equal vectors tie to the last digit in one of the two only, so scores are compared for all and results where no copy exists.
    assert {(r[0], r[2]) for r in got} == {(r[0], r[2]) for r in want}
    single = {r[0]: r[1] for r in want if int(r[1]) % 100 >= 10}
    assert {r[0]: r[1] for r in got if r[0] in single} == single


@pytest.fixture
def folder(tmp_path):
    p = tmp_path / "files"
    (p / "sub" / "deep").mkdir(parents=True)
    (p / "a.txt").write_text("first text of a")
    (p / "sub" / "deep" / "b.md").write_text("text of b")
    (p / "c.bin").write_text("not watched")
    return p


def wait(what, seconds=60):
    end = time.time() + seconds
    while not what():
        assert time.time() < end, "the stream did not get there in time"
        time.sleep(0.3)


def test_folder_as_a_stream(spark, folder, tmp_path):
    """Created, changed and deleted files reach the store; of two writes within the gap the last one is indexed."""
    store = Store(spark, str(tmp_path / "store")).create()
    seen = []
    sync = store.sync
    store.sync = lambda found: (seen.extend((p.rsplit("/", 1)[-1], c) for p, c in found), sync(found))[1] if found else None
    found = listing.changes(listing.listings(spark, str(folder), shares=3), gap=3.0)
    q = listing.index_changes(found, store).option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="500 milliseconds").start()
    texts = lambda: sorted(r["content"] for r in store.all().select("content").collect())
    try:
        wait(lambda: texts() == ["first text of a", "text of b"])
        (folder / "a.txt").write_text("second text")
        (folder / "a.txt").write_text("the third and last text")
        (folder / "sub" / "d.log").write_text("text of d")
        wait(lambda: texts() == ["text of b", "text of d", "the third and last text"])
        (folder / "sub" / "deep" / "b.md").unlink()
        wait(lambda: texts() == ["text of d", "the third and last text"])
    finally:
        q.stop()
    assert q.exception() is None
    assert seen.count(("b.md", "deleted")) == 1 and not any(name == "c.bin" for name, _ in seen)
    assert [c for n, c in seen if n == "d.log"] == ["modified"]
