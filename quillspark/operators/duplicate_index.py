"""A stored index of MinHash bands, against which new documents are decided batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import checkpoint, stored
from ..sources.store import Log
from . import dedup
from .fusion import top_per_query

#: Folders of band rows, by a hash of the bucket: a batch of few documents reads the folders of its own buckets.
SHARDS = 64
SCHEMAS = {
    "signatures": "doc_id long, signature array<long>",
    "bands": "doc_id long, band int, h long, shard int",
    "decisions": "doc_id long, kept boolean, canonical_doc_id long, similarity double",
    "settings": "threshold double, bands int, rows int",
}


class DuplicateIndex(Log):
    """Signatures of the documents kept so far and the buckets of their bands, in one commit log: a batch's decisions, signatures and buckets become visible together or not at all.

    A batch asks only for the buckets of its own bands; the texts of earlier documents are never read again.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.9):
        super().__init__(spark, path, SCHEMAS, {"bands": "shard"})
        self.create()
        found = self.read("settings").collect()
        if not found:
            self.write("settings", spark.createDataFrame([(threshold, *dedup.banding(threshold))], SCHEMAS["settings"]))
        elif found[0]["threshold"] != threshold:
            raise ValueError(f"the index was made for a threshold of {found[0]['threshold']}")
        self.threshold = threshold

    def _bands(self, signed: DataFrame) -> DataFrame:
        return dedup.band_rows(signed, self.threshold).withColumn("shard", F.pmod("h", F.lit(SHARDS)).cast("int"))

    def matches(self, signed: DataFrame, state: dict | None = None) -> DataFrame:
        """(doc_id, match_id, similarity) of kept documents whose signatures agree in a share of at least the threshold with those of signed (doc_id, signature)."""
        q = self._bands(signed)
        shards = [r["shard"] for r in q.select("shard").distinct().collect()]  # SHARDS at most
        held = self.read("bands", state).where(F.col("shard").isin(shards)).withColumnRenamed("doc_id", "match_id")
        met = held.join(q.select("shard", "band", "h").distinct(), ["shard", "band", "h"], "left_semi").select(F.col("match_id").alias("doc_id")).distinct()
        return dedup.lookup(signed, self.read("signatures", state).join(met, "doc_id", "left_semi"), self.threshold)

    def take(self, docs: DataFrame) -> DataFrame:
        """Decide docs (doc_id, text): one goes if it is like a kept one of an earlier batch, or like a kept one of this batch with a lesser id. The decisions (doc_id, kept, canonical_doc_id: the best match, similarity).

        With batches in id order the same documents are kept as by dedup.handle over all at once. Ids decided before are left out, so a batch that is sent again changes nothing. A document without shingles is kept and matches nothing.
        """
        signed = stored(dedup.fingerprints(docs.select("doc_id", "text")).dropDuplicates(["doc_id"]), "duplicate-signatures")
        out: list[DataFrame] = []

        def step(state: dict) -> dict:
            new = signed.join(self.read("decisions", state).select("doc_id"), "doc_id", "left_anti")
            early = checkpoint(self.matches(new, state))
            rest = new.join(early.select("doc_id").distinct(), "doc_id", "left_anti")
            pairs = checkpoint(dedup.lookup(rest, rest, self.threshold).where("match_id < doc_id"))
            gone = dedup._dropped(pairs)
            late = pairs.join(gone.select(F.col("doc_id").alias("match_id")), "match_id", "left_anti")
            best = top_per_query(early.unionByName(late).withColumnRenamed("similarity", "score"), 1, key="doc_id", item="match_id").select("doc_id", F.col("match_id").alias("canonical_doc_id"), F.col("score").alias("similarity"))
            decided = stored(new.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.col("canonical_doc_id").isNull().alias("kept"), "canonical_doc_id", "similarity"), "duplicate-decisions")
            kept = new.where("signature is not null").join(decided.where("kept").select("doc_id"), "doc_id", "left_semi")
            out[:] = [decided]
            # All tables are appended to; one of many folders is written anew, like those of a store.
            rows = {"decisions": decided, "signatures": kept, "bands": self._bands(kept).drop("signature")}
            return {name: self._added(state, name, x) for name, x in rows.items()}

        self.change(step)
        return out[0]

    def remove(self, ids: DataFrame) -> None:
        """Forget documents (doc_id): later ones are not compared with them, and they may be decided anew."""
        names = ("signatures", "bands", "decisions")
        self.change(lambda state: {name: (True, self.read(name, state).join(ids.select("doc_id"), "doc_id", "left_anti")) for name in names})

    def size(self) -> int:
        return self.read("signatures").count()

    def stream(self, docs: DataFrame):
        """A writer of a stream of documents (doc_id, text) whose batches are taken; start it with a checkpoint location. A batch that is repeated after a failure is decided once."""
        return docs.writeStream.foreachBatch(lambda batch, _: self.take(batch))
