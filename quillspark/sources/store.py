"""The persistent corpus: Parquet tables under one folder, and a log of numbered commits that says which folders each table is made of."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalise
from ..operators.providers import embed
from .loader import corpus_frame, discover
from .scratch import stored

# Table schemas.
SCHEMAS = {
    "docs": "doc_id long, content string, source_path string, char_count int, word_count int, indexed_at timestamp_ntz, language string, fingerprint string, is_duplicate boolean, canonical_doc_id long, metadata string",
    "embeddings": "doc_id long, embedding array<float>",
    "query_history": "query_id long, query_text string, semantic_weight double, lexical_weight double, top_k int, ts timestamp_ntz",
    "feedback": "feedback_id long, query_id long, doc_id long, relevance_score int, clicked boolean, ts timestamp_ntz",
    "suggestions": "query_text string, frequency long",
    "jobs": "job_id string, status string, progress double, message string, created_at timestamp_ntz, updated_at timestamp_ntz",
}

#: Appended folders of a version at most; the next append writes the table anew.
APPENDS = 32
#: Commits that stay in the log, and seconds that a folder of none of them stays, since a writer or reader may still be at it.
COMMITS, STAY = 64, 3600
#: Times that a write which meets another one's commit is made again.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer's commit came first, TRIES times."""


class Log:
    """Tables below one folder, of given schemas, some in folders by the values of a column.

    A write puts its rows into folders of unique names and then makes the commit file with the next number, by an operation that fails if that file is there: so a write that dies leaves folders that nobody reads, two writers never take one number, and the tables that a commit changes change together. Who loses reads the new state and does the step again. Readers keep the folders of the commit they began with.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], parted: dict[str, str] | None = None):
        self.spark, self.path, self.schemas, self.parted = spark, path.rstrip("/"), schemas, parted or {}
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    # The log. A commit holds the whole state: {table: {"version": of the last whole write, "folders": [...]}}.

    def commits(self) -> list[int]:
        log = self._at("commits")
        if not self._fs.exists(log):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(log))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def _state(self, number: int) -> dict:
        path = self._at(f"commits/{number:020d}.json")
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _latest(self) -> tuple[int, dict]:
        numbers = self.commits()
        return (numbers[-1], self._state(numbers[-1])) if numbers else (0, {})

    def _commit(self, number: int, state: dict) -> bool:
        """Make the commit file, whole or not at all; False if there is one of that number."""
        draft, path = self._at(f"commits/draft-{uuid.uuid4().hex}"), self._at(f"commits/{number:020d}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":  # where a rename would replace the other writer's file, a hard link fails
                files, paths = self._jvm.java.nio.file.Files, self._jvm.java.nio.file.Paths
                try:
                    files.createLink(paths.get(self._fs.makeQualified(path).toUri()), paths.get(self._fs.makeQualified(draft).toUri()))
                except Py4JJavaError as e:
                    if "FileAlreadyExists" in str(e.java_exception):
                        return False
                    raise
                return True
            return not self._fs.exists(path) and self._fs.rename(draft, path)
        finally:
            self._fs.delete(draft, False)

    def change(self, step: Callable[[dict], dict[str, tuple[bool, DataFrame]]]) -> None:
        """One commit: step(state) gives {table: (whole, rows)}, rows that replace a table or come to it. It may be called again with a newer state if another writer was first."""
        for _ in range(TRIES):
            number, state = self._latest()
            new = {k: dict(v) for k, v in state.items()}
            for name, (whole, rows) in step(state).items():
                folder = f"{name}/{uuid.uuid4().hex}"
                out, by = self._typed(name, rows), self.parted.get(name)
                (out.repartition(by).write.partitionBy(by) if by else out.write).parquet(f"{self.path}/{folder}")
                old = new.get(name, {"version": 0, "folders": []})
                new[name] = {"version": old["version"] + 1, "folders": [folder]} if whole else {"version": old["version"], "folders": [*old["folders"], folder]}
            if self._commit(number + 1, new):
                if any(new[t]["version"] != state.get(t, {}).get("version") for t in new):
                    self.vacuum()
                return
        raise Conflict(f"{self.path}: another writer was first {TRIES} times")

    def vacuum(self, stay: float = STAY) -> int:
        """Delete commits before the last COMMITS, and folders and drafts of no commit in the log that are older than `stay` seconds, those of writes that died among them; how many folders went."""
        numbers = self.commits()
        for n in numbers[:-COMMITS]:
            self._fs.delete(self._at(f"commits/{n:020d}.json"), False)
        used = {f for n in numbers[-COMMITS:] for t in self._state(n).values() for f in t["folders"]}
        before = self._jvm.java.lang.System.currentTimeMillis() - stay * 1000
        gone = 0
        for name in self.schemas:
            if self._fs.exists(self._at(name)):
                for s in self._fs.listStatus(self._at(name)):
                    if f"{name}/{s.getPath().getName()}" not in used and s.getModificationTime() <= before:
                        self._fs.delete(s.getPath(), True)
                        gone += 1
        for s in self._fs.listStatus(self._at("commits")):
            if s.getPath().getName().startswith("draft-") and s.getModificationTime() <= before:
                self._fs.delete(s.getPath(), False)
        return gone

    def versions(self, name: str) -> list[int]:
        """Versions of a table, each from a whole write, in the commits of the log."""
        return sorted({s[name]["version"] for s in map(self._state, self.commits()) if name in s})

    def create(self) -> Log:
        """Empty tables where there are none."""
        if set(self.schemas) - set(self._latest()[1]):
            self.change(lambda state: {name: (True, self.spark.createDataFrame([], schema)) for name, schema in self.schemas.items() if name not in state})
        return self

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        """A table as of the last commit, or of a state."""
        table = (self._latest()[1] if state is None else state).get(name)
        if table is None:
            return self.spark.createDataFrame([], self.schemas[name])
        read = self.spark.read.schema(self.schemas[name])
        if name not in self.parted:
            return read.parquet(*(f"{self.path}/{f}" for f in table["folders"]))
        parts = [read.parquet(f"{self.path}/{f}") for f in table["folders"]]  # each folder is a base of partitions
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def write(self, name: str, rows: DataFrame) -> None:
        """A new version, whatever others write meanwhile; the rows of old ones stay for readers that began with them."""
        self.change(lambda _: {name: (True, rows)})

    def update(self, name: str, step: Callable[[DataFrame], DataFrame]) -> None:
        """A new version made of the one before; step is called again if another writer was first."""
        self.change(lambda state: {name: (True, step(self.read(name, state)))})

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        cols = [f.split(" ")[0] for f in self.schemas[name].split(", ")]
        have = dict(rows.dtypes)
        kinds = dict(f.split(" ", 1) for f in self.schemas[name].split(", "))
        return rows.select(*((F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in cols))

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows in a folder of their own, so that only they are written; after APPENDS of them the table is written anew."""
        self.change(lambda state: {name: self._added(state, name, rows)})

    def _added(self, state: dict, name: str, rows: DataFrame) -> tuple[bool, DataFrame]:
        if len(state.get(name, {"folders": []})["folders"]) in range(1, APPENDS + 1):
            return False, rows
        return True, self.read(name, state).unionByName(self._typed(name, rows))


class Store(Log):
    """The tables of one corpus."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, SCHEMAS)

    def __enter__(self) -> Store:
        return self.create()

    def __exit__(self, *exc: object) -> None:
        return None

    def version(self) -> int:
        """Of the documents: it changes with a whole write."""
        return self._latest()[1].get("docs", {"version": 0})["version"]

    # Corpus.

    def _with_vectors(self, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", embed(F.col("content")).alias("embedding"))

    def replace(self, rows: DataFrame) -> DataFrame:
        """Index rows (content, source_path) afresh with ids from 0; metadata goes. Documents and vectors are one commit."""
        docs = stored(self._new(rows, 0), "new-docs")
        self.change(lambda _: {"docs": (True, docs), "embeddings": (True, self._with_vectors(docs))})
        return self.all()

    def replace_from(self, directory: str) -> DataFrame:
        return self.replace(discover(self.spark, directory).select("content", "source_path"))

    def add(self, rows: DataFrame) -> DataFrame:
        """Append rows with the next ids; only they are embedded. Another writer's documents in between move the ids on."""
        fresh = stored(self._new(rows, 0), "new-docs")

        def step(state: dict) -> dict:
            start = self.read("docs", state).agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("m")).collect()[0]["m"] + 1
            new = fresh.withColumn("doc_id", F.col("doc_id") + start)
            return {"docs": self._added(state, "docs", new), "embeddings": self._added(state, "embeddings", self._with_vectors(new))}

        self.change(step)
        return self.all()

    def sync(self, changes: list[tuple[str, str]]) -> DataFrame:
        """Take changes (path, created | modified | deleted) of files: rows of changed and deleted ones go, created and changed ones are added with the next ids; all other rows keep theirs. All of it is one commit."""
        if not changes:
            return self.all()
        gone = self.spark.createDataFrame([(p,) for p, kind in changes if kind != "created"], "source_path string")
        found = [p for p, kind in changes if kind != "deleted"]
        fresh = stored(self._new(discover(self.spark, found).select("content", "source_path"), 0), "new-docs") if found else None

        def step(state: dict) -> dict:
            docs, vectors = self.read("docs", state), self.read("embeddings", state)
            start = docs.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("m")).collect()[0]["m"] + 1
            new = self._typed("docs", fresh.withColumn("doc_id", F.col("doc_id") + start)) if fresh is not None else None
            if gone.isEmpty():
                return {"docs": self._added(state, "docs", new), "embeddings": self._added(state, "embeddings", self._with_vectors(new))} if new is not None else {}
            ids = docs.join(gone, "source_path", "left_semi").select("doc_id")
            docs, vectors = docs.join(gone, "source_path", "left_anti"), vectors.join(ids, "doc_id", "left_anti")
            if new is not None:
                docs, vectors = docs.unionByName(new), vectors.unionByName(self._typed("embeddings", self._with_vectors(new)))
            return {"docs": (True, docs), "embeddings": (True, vectors)}

        self.change(step)
        return self.all()

    def _new(self, rows: DataFrame, start: int) -> DataFrame:
        return with_ids(rows, start).transform(lambda d: corpus_frame(d.withColumn("content", normalise(F.col("content"))), normal=True)).withColumn("indexed_at", F.localtimestamp()).withColumn("fingerprint", content_hash(F.col("content"))).withColumn("is_duplicate", F.lit(False))

    def all(self) -> DataFrame:
        return self.read("docs").orderBy("doc_id")

    def page(self, offset: int = 0, limit: int = 100) -> DataFrame:
        return page(self.read("docs"), offset, limit)

    # Metadata.

    def metadata(self, doc_id: int) -> str | None:
        got = self.read("docs").where(F.col("doc_id") == doc_id).select("metadata").collect()
        return got[0]["metadata"] if got else None

    def set_metadata(self, updates: DataFrame) -> None:
        """metadata of updates (doc_id, metadata JSON) replaces that of the same ids; unknown ids are ignored."""
        u = updates.groupBy("doc_id").agg(F.max("metadata").alias("_new"))
        self.update("docs", lambda docs: docs.join(u, "doc_id", "left").withColumn("metadata", F.coalesce("_new", "metadata")).drop("_new"))

    def query(self, where: str | F.Column) -> DataFrame:
        return self.read("docs").where(where).select("doc_id")

    # Exchange.

    def export_json(self, path: str) -> None:
        """One JSON object a line: the document's fields and its vector."""
        self.read("docs").join(self.read("embeddings"), "doc_id", "left").write.mode("overwrite").json(path)

    def import_json(self, path: str) -> DataFrame:
        """Index the contents of an export; ids start again, vectors are made anew."""
        return self.replace(self.spark.read.schema("doc_id long, content string, source_path string").json(path).select("content", "source_path"))


def with_ids(rows: DataFrame, start: int = 0) -> DataFrame:
    """rows with dense doc_id from start, in the order of (source_path, content), without a window over one partition: places within sorted ranges plus the sizes of the ranges before."""
    key = [c for c in ("source_path", "content") if c in rows.columns]
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    # Written once: evaluated again, the sample that ranges are cut by is another one, and places and sizes of the ranges would not go together.
    r = stored(r.withColumn("_i", F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)), "placed")
    sizes = r.groupBy("_p").agg((F.max("_i") + 1).alias("n"))
    starts = sizes.alias("a").join(sizes.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy("a._p").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("_s"))
    return r.join(F.broadcast(starts), "_p").withColumn("doc_id", F.col("_s") + F.col("_i") + start).drop("_p", "_m", "_i", "_s")


def page(rows: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000, offset 0 or more")
    return rows.orderBy("doc_id").offset(offset).limit(limit)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", compare: tuple[str, ...] = ("size",)) -> DataFrame:
    """(path, change): created, modified or deleted between two listings."""
    a, b = old.select(F.col(key).alias("path"), F.struct(*compare).alias("x")), new.select(F.col(key).alias("path"), F.struct(*compare).alias("y"))
    kind = F.when(F.col("x").isNull(), "created").when(F.col("y").isNull(), "deleted").when(~F.col("x").eqNullSafe(F.col("y")), "modified")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change")).where("change is not null")


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(by)))).where("_r = 1").drop("_r")
