"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, join_on_key, small, stored, text_batches
from .components import connected_components
from .words import hash_words, mix, shingle

#: Signature length and rows of a band: at a similarity of 0.8, a pair shares none of the 32 bands with probability 5e-8.
SLOTS, ROWS = 128, 4
#: Elements whose permutations are held at once.
ELEMENTS = 32_768

SCHEMA = "doc_id long, th long, n_shingles long, key1 long, key2 long, bands array<long>, sketch binary"


def _uniform(e: np.ndarray, step: int, salt: int) -> np.ndarray:
    return mix(e + np.uint64((0x9E3779B97F4A7C15 * (2 * step + salt + 1)) & ((1 << 64) - 1)))


def superminhash(elements: np.ndarray, owner: np.ndarray, n_owners: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_owners x slots; inf without elements) of sets given as 64-bit elements and their set's number.

    Each element draws a random permutation of the slots one place after the other, the j-th place with a rank in [j, j + 1); a set needs no more places once every slot has a value below the next rank.
    """
    sig = np.full(n_owners * slots, np.inf)
    perm = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
    e, own = elements, owner.astype(np.int64)
    for j in range(slots):
        if not len(e):
            break
        r = (_uniform(e, j, 0) >> np.uint64(11)) * (1.0 / (1 << 53)) + j
        k = j + ((_uniform(e, j, 1) >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        at = np.arange(len(e))
        slot = perm[at, k]
        perm[at, k] = perm[:, j]
        perm[:, j] = slot
        np.minimum.at(sig, own * slots + slot, r)
        worst = sig.reshape(n_owners, slots).max(axis=1)
        go = (worst > j + 1)[own]
        if not go.all():
            e, own, perm = e[go], own[go], perm[go]
    return sig.reshape(n_owners, slots)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; fewer words than width are one shingle, none are no set."""
    h, first, *_ = hash_words(texts)
    s = shingle(h, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            acc = h[a : a + 1] ^ np.uint64(0x5851F42D4C957F2D)
            for k in range(a + 1, b):
                acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + h[k : k + 1])
            out.append(acc)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, hash of the text, size of the shingle set, 128 bits that stand for the set, band hashes and a byte of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs, texts in text_batches(batches, 1 << 20):
            keys, hashes = [x["doc_id"] for x in pairs], [x["th"] for x in pairs]
            sets = shingle_sets(texts, width)
            n = [len(s) for s in sets]
            k1, k2, bands, sketch = [], [], [], []
            lo = 0
            while lo < len(sets):
                hi, total = lo, 0
                while hi < len(sets) and (hi == lo or total + n[hi] <= ELEMENTS):
                    total += n[hi]
                    hi += 1
                if n[lo] > ELEMENTS:  # a very long text: in parts, whose signatures combine by minimum
                    sig = np.full((1, SLOTS), np.inf)
                    for at in range(0, n[lo], ELEMENTS):
                        part = sets[lo][at : at + ELEMENTS]
                        sig = np.minimum(sig, superminhash(part, np.zeros(len(part), dtype=np.int64), 1))
                else:
                    sig = superminhash(np.concatenate(sets[lo:hi]), np.repeat(np.arange(hi - lo), n[lo:hi]), hi - lo)
                bits = mix(sig.view(np.uint64))
                sketch += [row.tobytes() for row in (bits & np.uint64(255)).astype(np.uint8)]
                acc = np.zeros((hi - lo, SLOTS // ROWS), dtype=np.uint64) + np.arange(SLOTS // ROWS, dtype=np.uint64)
                for r in range(ROWS):
                    acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + bits[:, r::ROWS])
                for i, row in zip(range(lo, hi), _signed(acc).tolist(), strict=True):
                    bands.append(row if n[i] else [])
                lo = hi
            for s in sets:
                m = mix(s)
                k1.append(int(m.sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(np.bitwise_xor.reduce(mix(m + np.uint64(77))).view(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "th", "n_shingles", "key1", "key2", "bands", "sketch"],
            )

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("th")), text).mapInArrow(run, SCHEMA)


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full shingle sets of texts (id, text)."""
    one = texts.select("id", "text")
    both = pairs.hint("merge").join(one.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(one.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = x.column(0).to_numpy(), x.column(1).to_numpy()
            left, right = x.column(2).to_pylist(), x.column(3).to_pylist()
            keep = []
            for lo in range(0, len(a), 64):
                at = shingle_sets([t or "" for t in left[lo : lo + 64]], width)
                bt = shingle_sets([t or "" for t in right[lo : lo + 64]], width)
                for i, (s, t) in enumerate(zip(at, bt, strict=True)):
                    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)) or not len(s):
                        continue
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        keep.append(lo + i)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _short_sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, set): 32 bits of each shingle hash of the wanted texts (id, text), sorted."""
    texts = texts.select("id", "text").join(ids.hint("merge"), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, batch in text_batches(batches, 1 << 20):
            sets = [np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s in shingle_sets(batch, width)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])

    return texts.mapInArrow(run, "id long, set binary").dropDuplicates(["id"])


def _forest(members: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) that join components met in one bucket: a spanning forest, never all pairs.

    members: bucket, band, id, component, sketch, bands (hashes), n (size of the set), set, size (rows of the bucket). Buckets are cut into pairs of blocks of bounded size. A pair is tried in the lowest band it shares, if its sketches come within four standard deviations of the threshold, on the whole sets, nearest first, and only while its components are apart.
    """
    least = percent / 100 - 0.14
    m = members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))

    def run(table: pa.Table) -> pa.Table:
        ids, comp, part = table["id"].to_numpy(), table["component"].to_numpy(), table["part"].to_numpy()
        n, band = table["n"].to_numpy(), table["band"][0].as_py()
        sk = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        hashes = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        sets = [np.frombuffer(x, dtype="<u4") for x in table["set"].to_pylist()]
        across = table["lo"][0].as_py() != table["hi"][0].as_py()
        # Components as small numbers, merged as links turn up.
        _, comp = np.unique(comp, return_inverse=True)
        out_a, out_b = [], []
        for i in range(len(ids)):
            ok = (comp != comp[i]) & (ids > ids[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if across:
                ok &= part != part[i]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            near = (sk[at] == sk[i]).mean(axis=1)
            good = (near >= least) & ((hashes[at] == hashes[i]).argmax(axis=1) == band)
            at, near = at[good], near[good]
            for j in at[np.argsort(-near, kind="stable")].tolist():
                if comp[j] == comp[i]:
                    continue
                x, y = sets[i], sets[j]
                common = len(np.intersect1d(x, y, assume_unique=True))
                # One shared hash may be chance, one lost by two equal ones: such pairs are links to confirm, but merge nothing.
                if 100 * (common + 1) >= percent * (len(x) + len(y) - common - 1):
                    out_a.append(ids[i])
                    out_b.append(ids[j])
                    if 100 * (common - 1) >= percent * (len(x) + len(y) - common + 1):
                        comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return m.select("bucket", "lo", "hi", "band", "id", "component", "part", "n", "sketch", "bands", "set").groupBy("bucket", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, leader) of every row of docs; leader: the text's hash of the row that stands for the component, the least of the least id."""
    base = stored(signatures(docs, width).withColumn("set", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("key1", "key2", "n_shingles"))), "minhash")
    named = base.where("set is not null")
    # Equal sets are one class; one row stands for it.
    classes = stored(named.groupBy("set").agg(F.min(F.struct("doc_id", "th")).alias("s"), F.count(F.lit(1)).alias("rows")).select("set", "s.*", "rows"), "minhash-classes")
    one = stored(named.join(classes.select("set", "doc_id", "th").hint("merge"), ["set", "doc_id", "th"]).dropDuplicates(["set"]).withColumnRenamed("set", "id"), "minhash-one")
    rows = one.select("id", F.posexplode("bands").alias("band", "bucket"))
    centres = rows.groupBy("bucket").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    star = stored(rows.join(centres, "bucket").select("bucket", "band", "id", "centre", "size"), "minhash-buckets")
    pairs = star.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    # Only texts that share a bucket are looked at again; they are fetched once.
    met = stored(one.select("id", "doc_id", "th").join(star.select("id").distinct().hint("merge"), "id", "left_semi"), "minhash-met")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    texts = stored(texts.join(small(met), ["doc_id", "th"]).select("id", "text").dropDuplicates(["id"]), "minhash-texts")
    sure = stored(verify(pairs, texts, width, percent), "minhash-links")
    first = stored(connected_components(sure), "minhash-components")

    # Buckets in which some class is not in the component of the centre.
    placed = star.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    members = stored(placed.join(split, "bucket").select("bucket", "band", "id", "component", "size"), "minhash-members")
    whole = one.select("id", F.col("n_shingles").alias("n"), "sketch", "bands").join(_short_sets(texts, members.select("id").distinct(), width), "id")
    second = stored(_forest(members.join(whole, "id"), percent), "minhash-pairs")
    more = stored(verify(second, texts, width, percent), "minhash-links")
    if more.take(1):
        before, first = first, stored(connected_components(sure.unionByName(more)), "minhash-components")
        discard(before)
    discard(star, texts, members, second, one, met)
    # The least row of each component, then of each class of it.
    of = classes.join(first.withColumnRenamed("id", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    of = stored(of, "minhash-placed")
    least = of.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("l"), F.count(F.lit(1)).alias("n"))
    known = stored(join_on_key(of.select("set", "component", "rows"), least, ["component"], rows="n").select("set", "rows", F.col("l.doc_id").alias("component_id"), F.col("l.th").alias("leader")), "minhash-known")
    discard(sure, more, first, classes, of)
    few = base.select("doc_id", "th", "n_shingles", "set")
    alone = few.where("set is null").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"), F.col("th").alias("leader"))
    return join_on_key(few.where("set is not null"), known, ["set"], rows="rows").select("doc_id", "th", "n_shingles", "component_id", "leader").unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by 100 * intersection >= percent * union of their sets of width-word shingles.

    Returns one row for each row of docs: doc_id, n_shingles, component_id (least doc_id reachable through links), kept (doc_id = component_id).
    Equal sets are one class. In each band bucket every class is checked against the bucket's least class; only where such a check fails are classes of different components compared on their sets, in blocks of bounded size. So a group of copies costs a row each, not a row for each pair, and links between different texts hold up to the sketches' error (5e-8 a pair for the bands, 4e-5 for the threshold of the second comparison).
    Null text or text without words is an empty set, linked with nothing. Rows are documents of their own, also where they share a doc_id; rows with a null doc_id stand alone (component null, kept). Very long texts are signed in parts; an empty table gives an empty result; other columns, whatever their names, are not looked at.
    """
    return _grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that stand for their group: of each group the row of the least doc_id, and of rows that share that id the one with the least hash of its text.

    Rows with a null id and rows without words stay, all of them; of rows equal in id and text one stays, whatever their other columns. Columns may have any names; an empty table gives an empty result.
    """
    groups = stored(_grouped(docs, width, percent).where("doc_id is not null and n_shingles > 0").select("doc_id", "th", ((F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("leader"))).alias("stays")), "minhash-rows")
    i, h = fresh(docs, "gone_id"), fresh(docs, "gone_text")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    gone = stored(groups.where("not stays").select(F.col("doc_id").alias(i), F.col("th").alias(h)).distinct(), "minhash-gone")
    left = docs.join(small(gone), (docs["doc_id"].cast("long") == F.col(i)) & (F.xxhash64(text) == F.col(h)), "left_anti")
    twice = groups.where("stays").groupBy("doc_id", "th").count().where("count > 1")
    if not twice.take(1):
        return left
    twice = twice.select(F.col("doc_id").alias(i), F.col("th").alias(h))
    same = (left["doc_id"].cast("long") == F.col(i)) & (F.xxhash64(F.coalesce(left["text"].cast("string"), F.lit(""))) == F.col(h))
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
