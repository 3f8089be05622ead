"""Trie of the common beginnings of conversations, built level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_on_key, shuffle_width, stored, tune


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row its place in the run of equal conv_id (column 1) of the sorted partition."""
    last, n = None, 0
    for b in batches:
        ids = b.column(1).to_numpy()
        if not len(ids):
            continue
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        sizes = np.diff(np.append(first, len(ids)))
        pos = np.arange(len(ids)) - np.repeat(first, sizes)
        if ids[0] == last:
            pos[: sizes[0]] += n
        last, n = ids[-1], int(pos[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos, pa.int64())], ["part", "conv_id", "turn", "n_bytes", "pos"])


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, turn, n_bytes) for each row: its place in its conversation from 0, a SHA-256 of role and text, and the text's UTF-8 bytes.

    Turns are ordered by turn_col, null first; equal ones by role, then by that digest. Null roles and texts are empty. Rows with a null conversation are left out, repeated rows are turns of their own, an empty table gives none, and other columns aren't looked at.
    Rows are range-partitioned by all of that order (and at random within equal rows), so that a conversation of any length is many tasks; only the texts' digests are shuffled. Conversations that reach over a partition's end are at most one a partition, and what their earlier partitions hold is broadcast.
    """
    spark = conversations.sparkSession
    tune(spark)
    c = conversations
    role, text = (F.coalesce(c[x].cast("string"), F.lit("")) for x in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = c.select(c[conv_col].cast("long").alias("conv_id"), c[turn_col].alias("at"), role.alias("role"), digest.alias("turn"), F.octet_length(text).cast("long").alias("n_bytes"), F.rand(7).alias("salt")).where("conv_id is not null")
    order = [F.col("conv_id"), F.col("at").asc_nulls_first(), F.col("role"), F.col("turn"), F.col("salt")]
    dealt = slim.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv_id", "turn", "n_bytes")
    placed = stored(dealt.mapInArrow(_positions, "part int, conv_id long, turn binary, n_bytes long, pos long"), "trie-turns")
    edges = placed.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    across = edges.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("conv_id")).groupBy("conv_id").count().where("count > 1").select("conv_id")
    runs = placed.join(F.broadcast(across), "conv_id", "left_semi").groupBy("conv_id", "part").agg((F.max("pos") + 1).alias("n"))
    before = runs.select("conv_id", "part", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return placed.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "turn", "n_bytes")


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (of numbered) and lengths of conversations that start like others: conversation c gets the first h turns of c - c % family (all if fewer, none if absent), then its own after its first h; h is the unsigned crc32 of c's decimal text modulo heads.

    Returns (conv_id, pos, turn, n_bytes) and (conv_id, length), the latter for turnless conversations too.
    """
    lengths = stored(turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("length")), "trie-lengths")
    base = F.col("conv_id") - F.col("conv_id") % family
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = base == F.col("conv_id")
    ids = lengths.select("conv_id", "length", base.alias("base"), F.when(own, F.lit(0)).otherwise(head).alias("cut"))
    shifts = ids.join(lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("there")), "base", "left").select("conv_id", "base", "length", "cut", F.least("cut", F.coalesce("there", F.lit(0))).alias("put"))
    shifts = stored(shifts, "trie-shifts", tidy=False)
    kept = join_on_key(turns, shifts.select("conv_id", "length", "cut", "put"), ["conv_id"], rows="length").where("pos >= cut").select("conv_id", (F.col("pos") - F.col("cut") + F.col("put")).alias("pos"), "turn", "n_bytes")
    taken = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads - 1)).select(F.col("conv_id").alias("base"), "pos", "turn", "n_bytes").join(shifts.where("put > 0").select("conv_id", "base", "put"), "base").where("pos < put").select("conv_id", "pos", "turn", "n_bytes")
    return kept.unionByName(taken), shifts.select("conv_id", (F.col("put") + F.greatest(F.col("length") - F.col("cut"), F.lit(0))).alias("length"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, node, conv_id) to comma-joined runs of conv_id: (depth, node, first, ids)."""
    for b in batches:
        depth, node, ids = (b.column(i).to_numpy() for i in range(3))
        if not len(ids):
            continue
        first = np.flatnonzero(np.concatenate(([True], (depth[1:] != depth[:-1]) | (node[1:] != node[:-1]))))
        text = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(first, [*first[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(depth[first]), pa.array(node[first]), pa.array(ids[first]), pa.array(text, pa.string())], ["depth", "node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the runs of each node, one after the other; no more than one batch is held."""
    now, sha = None, None
    for b in batches:
        out = []
        for depth, node, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (depth, node) != now:
                if now:
                    out.append((*now, sha.hexdigest()))
                now, sha = (depth, node), hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        if out:
            yield _ends(out)
    if now:
        yield _ends([(*now, sha.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    d, n, s = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.string())], ["depth", "conv_id", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of nodes from their ending conversations (depth, node, conv_id): hash of the ids, ascending, comma-joined.

    Sorted runs of ids are written out as text in parallel; one task then hashes a node's runs as they come, since SHA-256 takes its bytes in order, without holding them.
    """
    width = shuffle_width(members.sparkSession)
    runs = members.repartitionByRange(width, "depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id").mapInArrow(_joined, "depth long, node long, first long, ids string")
    return runs.repartition(width, "depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_hashed, "depth long, conv_id long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each distinct beginning of conversations: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, pos, turn, n_bytes) with pos from 0 without gaps, equal turns having equal `turn`; lengths: (conv_id, length) of all conversations, turnless ones too.
    Downward, each level groups the live conversations by (parent node, next turn); a node is named by its least member. A conversation alone in a node is live no more: the rest of it is a chain with one member, written down without further levels. So there are as many levels as turns in the longest beginning that two conversations share. Upward, each level's children are summed into their parents. Groups are combined before they are shuffled, and nodes of over a thousandth of the rows are broadcast to their members.
    Without conversations there is no row, not even a root. conv_id and pos must not be null.
    """
    spark = turns.sparkSession
    tune(spark)
    turns = stored(turns.sortWithinPartitions("pos"), "trie-rebuilt")
    lengths = stored(lengths, "trie-conversations", tidy=False)
    total = lengths.agg(F.min("conv_id").alias("root"), F.count(F.lit(1)).alias("n")).collect()[0]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not total["n"]:
        discard(turns)
        return lengths.where("false").select(*(F.lit(None).cast("string" if c == columns[-1] else "long").alias(c) for c in columns))

    def with_next(members: DataFrame, depth: int) -> DataFrame:
        return stored(members.join(turns.where(F.col("pos") == depth).select("conv_id", "turn", "n_bytes").hint("merge"), "conv_id", "left"), "trie-live")

    live = [with_next(lengths.withColumn("node", F.lit(total["root"]).cast("long")), 0)]
    levels = []  # of depth 1 and on: (node, turn) is the parent and what follows it, child the node's name
    while True:
        now = live[-1]
        groups = stored(now.where("turn is not null").groupBy("node", "turn").agg(F.min("conv_id").alias("child"), F.count(F.lit(1)).alias("n"), F.first("n_bytes").alias("n_bytes"), F.max("length").alias("length")), "trie-nodes", tidy=False)
        levels.append(groups)
        shared = groups.where("n > 1").select("node", "turn", "child", "n")
        if shared.isEmpty():
            break
        members = join_on_key(now.where("turn is not null").select("conv_id", "length", "node", "turn"), shared, ["node", "turn"], rows="n")
        live.append(with_next(members.select("conv_id", "length", F.col("child").alias("node")), len(live)))
    root = spark.range(1).select(F.lit(None).cast("long").alias("node"), F.lit(total["root"]).cast("long").alias("child"), F.lit(total["n"]).cast("long").alias("n"), F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("long").alias("length"))
    levels = [root, *(g.drop("turn") for g in levels)]

    sums, out = None, []
    for depth in reversed(range(len(levels))):
        level = levels[depth]
        many = level if depth == 0 else level.where("n > 1")
        own = (F.col("n") - 1) * F.col("n_bytes")
        if sums is None:
            rolled = many.select("node", "child", "n", F.lit(0).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), own.alias("saved"))
        else:
            rolled = many.join(sums.hint("merge"), "child", "left").select("node", "child", "n", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), (F.coalesce("saved", F.lit(0)) + own).alias("saved"))
        rolled = stored(rolled, "trie-rolled", tidy=False)
        out.append(rolled.select(F.lit(depth).cast("long").alias("depth"), "node", "child", "n", "children", "leaves", "saved"))
        if depth:
            alone = level.where("n = 1")
            each = rolled.select("node", "leaves", "saved").unionByName(alone.select("node", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
            sums = each.groupBy(F.col("node").alias("child")).agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            chain = alone.select("node", "child", "length", F.lit(depth).cast("long").alias("start")).select("node", "child", "length", "start", F.explode(F.sequence("start", "length")).alias("depth"))
            out.append(chain.select("depth", F.when(F.col("depth") == F.col("start"), F.col("node")).otherwise(F.col("child")).alias("node"), "child", F.lit(1).cast("long").alias("n"), (F.col("depth") < F.col("length")).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
    nodes = out[0]
    for x in out[1:]:
        nodes = nodes.unionByName(x)
    nodes = nodes.select(F.col("child").alias("conv_id"), "depth", F.col("node").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ending = None
    for depth, x in enumerate(live):
        x = x.where("turn is null").select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id")
        ending = x if ending is None else ending.unionByName(x)
    many, alone = nodes.where("n_convs > 1 or depth = 0"), nodes.where("n_convs = 1 and depth > 0")
    many = many.join(ends(ending), ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    alone = alone.withColumn("ends_sha256", F.sha2(F.when(F.col("n_children") == 0, F.col("conv_id").cast("string")).otherwise(F.lit("")), 256))
    return many.select(*columns).unionByName(alone.select(*columns))
