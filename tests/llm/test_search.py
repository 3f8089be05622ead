"""Hard negatives, language identification and the prefix trie against plain definitions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import cross_parsing, hard_negatives, prefix_trie, queries
from quillspark.llm.common import tune

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, embedding array<double>, score double, list int, aid long"


def nearest(rows, scale=256, positives=5, negatives=3):
    """Every anchor against every row, row by row."""
    rows = sorted({(i, str(l), tuple(math.floor(scale * x) for x in e)) for i, l, e in rows if None not in (i, l, e) and all(x is not None and math.isfinite(x) for x in e)})
    out = []
    for a in (r for r in rows if r[0] % 50 == 0):
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r) for r in rows if len(r[2]) == len(a[2]) and r != a)
        for s, i, _ in [x for x in scored if x[2][1] == a[1]][:positives]:
            n = [x for x in scored if x[2][1] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a[0], i, k, x[1], -s, -x[0]) for k, x in enumerate(n, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [512, 7])
def test_hard_negatives(spark, block, monkeypatch):
    """Ties, equal vectors under many ids, nulls, odd lengths, repeated rows and clashing columns."""
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    r = np.random.default_rng(4)
    centers = r.normal(size=(6, 8))
    rows = [(i, int(r.integers(0, 3)), [float(x) for x in np.round(centers[r.integers(0, 6)] + r.normal(size=8) * 0.3, 1)]) for i in range(500)]
    rows += [(1000 + i, i % 2, [1.0] * 8) for i in range(150)]  # a third of the anchors' rows are one vector
    rows += [(2000, 1, None), (2050, None, [1.0] * 8), (2100, 1, [1.0, None] * 4), (2150, 1, [math.nan] * 8), (2200, 1, [math.inf] + [0.0] * 7), (None, 1, [1.0] * 8)]
    rows += [(2250, 1, [2.0, 1.0]), (2251, 1, [2.0, 1.0]), (2252, 2, [1.0, 1.0]), (2300, 1, []), (2301, 1, []), (2302, 0, []), (2350, 1, [0.0] * 8), rows[0], rows[50]]
    got = hard_negatives.hard_negatives(spark.createDataFrame([(*x, 0.0, 0, 0) for x in rows], VECTORS), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == nearest(rows)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]


def test_hard_negatives_none(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0], 0.0, 0, 0)], VECTORS)
    assert hard_negatives.hard_negatives(one, F.lit(True)).count() == 0
    with pytest.raises(Exception, match="too long for exact scores"):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, 1, [1e9], 0.0, 0, 0)], VECTORS), F.lit(True)).count()


def test_lists_are_skipped(spark):
    """Where vectors form tight groups, bounds hold for every row and most lists aren't visited."""
    tune(spark)
    r = np.random.default_rng(2)
    centers = r.normal(size=(40, 16))
    x = np.floor(256 * (centers[np.arange(1600) % 40] + r.normal(size=(1600, 16)) * 0.01)).astype("<i4")
    rows = spark.createDataFrame([(i, "a", bytearray(v.tobytes())) for i, v in enumerate(x)], "vec_id long, label string, v binary")
    lists = hard_negatives.fit(rows)
    x = x.astype(float)
    near, far = lists.nearest(x)
    assert len(lists.centroids[16]) == 40
    lists.radii[16] = np.array([far[near == i].max(initial=0) for i in range(40)])
    low, high = lists.bounds(x[:50])
    s = x[:50] @ x.T
    assert (low[:, near] <= s).all() and (s <= high[:, near]).all()
    kth = -np.sort(-s, axis=1)[:, 5]
    assert (high >= kth[:, None]).mean() < 0.3


def longest(sample, text):
    """Phrases of a text, cut from left to right into the longest substrings of the sample's pieces."""
    n = i = 0
    pieces = sample.split(b"\0")
    while i < len(text):
        j = i + 1
        while j < len(text) and any(text[i : j + 1] in p for p in pieces):
            j += 1
        n, i = n + 1, j
    return n


def test_phrases():
    r = random.Random(3)
    samples = {k: b"\0".join(bytes(r.choice(abc) for _ in range(60)) for _ in range(5)) for k, abc in (("x", b"abc "), ("y", b"abd "), ("z", b"bcd"))}
    model = cross_parsing.learn(samples)
    units = [bytes(r.choice(b"abcde ") for _ in range(r.randrange(1, 90))) for _ in range(40)] + [samples["x"][:40], b"aaaa" * 20]
    got = model.phrases([np.frombuffer(u, dtype=np.uint8) for u in units])
    assert got.tolist() == [[longest(samples[k], u) for k in "xyz"] for u in units]
    assert cross_parsing.learn({"a": b"", "b": b" \0 "}).names == []


def test_languages(spark):
    """Held-out accuracy, and odd texts."""
    got = queries.op12_cross_parsing(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) and 0 <= x["score"] <= 1 for x in got)
    held = [x for x in got if x["held_out"] and x["lang"]]
    assert sum(x["lang"] == x["lang_pred"] for x in held) >= 0.99 * len(held) > 100


def test_language_edges(spark):
    words = {"en": "the house of the rising sun and its many windows ", "de": "das haus und die vielen fenster über der straße "}
    rows = [(i, " ".join(random.Random(i).sample((w * 3).split(), 12)), k, 0) for i, (k, w) in enumerate(list(words.items()) * 30)]
    schema = "doc_id long, text string, lang string, score int"
    model = cross_parsing.fit(spark.createDataFrame([*rows, (None, None, "fr", 0), (1, "le la", None, 0), (2, "", "it", 0), (3, "123 !", "xx", 0)], schema))
    assert model.names == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "123 !?_ ½"), (4, "The WINDOWS of the house"), (4, "The WINDOWS of the house"), (None, "Die STRASSE über der Straße"), (6, "the " * 200_000), (7, "x" * 50_000), (8, "日本語")]
    out = cross_parsing.identify(spark.createDataFrame([(i, t, "en", 5) for i, t in odd], schema), model).collect()
    assert len(out) == len(odd)
    by = {x["doc_id"]: x for x in out}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and [by[i]["score"] for i in (1, 2, 3)] == [0.0] * 3
    assert (by[4]["lang_pred"], by[None]["lang_pred"], by[6]["lang_pred"]) == ("en", "de", "en")
    assert by[7]["n_phrases"] == 50_000 or by[7]["lang_pred"] in ("en", "de")
    assert by[8]["lang_pred"] in ("en", "de") and by[8]["n_phrases"] == 9
    empty = cross_parsing.fit(spark.createDataFrame([], schema))
    assert {x["lang_pred"] for x in cross_parsing.identify(spark.createDataFrame([(1, "text", None, 0)], schema), empty).collect()} == {"und"}
    assert cross_parsing.identify(spark.createDataFrame([], schema), model).count() == 0


def beginnings(conversations):
    """The trie by dictionaries: conversations as tuples of turns by id."""
    members = defaultdict(list)
    for c, t in conversations.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        m = sorted(members[p])
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in m if len(conversations[c]) == len(p))
        out.append((m[0], len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: tuple(x[2:] for x in sorted(t)) for c, t in by.items()}
    head = lambda c: zlib.crc32(str(c).encode()) % 9
    return {c: t if c % 5 == 0 else turns.get(c - c % 5, ())[: head(c)] + t[head(c) :] for c, t in turns.items()}


def build(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, node string")
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(df)))


def test_trie(spark):
    """Random conversations with few different turns, nulls, absent and turnless ones, a long one, and one that most repeat."""
    r = random.Random(8)
    rows = []
    for c in range(120):
        if c % 5 == 0 and c % 3 == 0:
            continue
        for k in range(r.randrange(1, 7)):
            rows.append((c, k if r.random() < 0.9 or k else None, r.choice(["user", "assistant", None]), r.choice(["a", "b", "ü" * 3, None]), 1, "x"))
    rows += [(200 + c, k, "user", f"same {k}", 1, "x") for c in range(0, 300, 5) for k in range(3)]
    rows += [(601, k, "user", f"{k}", 1, "x") for k in range(700)] + [(None, 1, "user", "a", 1, "x")]
    r.shuffle(rows)
    by_turn = {(x[0], x[1]) for x in rows}
    assert len(by_turn) == len(rows)
    got = sorted(map(tuple, build(spark, rows).collect()), key=str)
    assert got == beginnings(rebuilt(rows))


def test_trie_edges(spark):
    assert build(spark, []).count() == 0
    one = [(1, 0, "user", "a", 0, "")]
    assert list(map(tuple, build(spark, one).collect())) == beginnings(rebuilt(one))
    repeated = [(5, 0, "user", "a", 0, "")] * 4 + [(10, 0, "user", "a", 0, "")] * 5 + [(-3, None, None, None, 0, "")]
    assert sorted(map(tuple, build(spark, repeated).collect()), key=str) == beginnings(rebuilt(repeated))
    # Equal turn numbers: by role, then by a digest, the same for every conversation.
    ties = [(c, 1, "user", t, 0, "") for c in (5, 10, 15) for t in random.Random(c).sample("abcdefgh", 8)]
    got = build(spark, ties)
    assert (got.count(), got.where("n_convs = 3").count()) == (9, 9)


def test_ids_of_a_node_in_runs(spark):
    """Ids of a node from several partitions are hashed in ascending order."""
    rows = [(2, 7, i) for i in range(3000)] + [(2, 8, 5), (3, 7, -1), (3, 7, 10)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "depth long, node long, conv_id long")
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {tuple(x) for x in prefix_trie.ends(df).collect()} == {(2, 7, sha(range(3000))), (2, 8, sha([5])), (3, 7, sha([-1, 10]))}
