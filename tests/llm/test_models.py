"""Models and filters: scores against definitions, accuracy on held-out rows, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontamination, pitman_yor, queries, toxicity
from quillspark.llm.common import tune
from quillspark.llm.words import hash_words, mix

SF = "/root/testdata/sf0.001"


def test_queries_are_there():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_pitman_yor(spark):
    tune(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(10_001, None), (10_002, ""), (None, "the the")], "doc_id long, text string"), allowMissingColumns=True)
    tokens = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"])), "\0"] for r in docs.collect()}
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in pitman_yor.score_documents(docs).collect()}
    assert len(got) == len(tokens)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(t), sum(w in c for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert pitman_yor.score_documents(docs.limit(0)).count() == 0


def test_tables_bounds():
    r = np.random.default_rng(1)
    c = r.integers(0, 5000, 500)
    t = pitman_yor.tables(c, np.full(500, 3.0), 0.5, r.integers(0, 1 << 63, 500, dtype=np.uint64), 1)
    assert ((t >= (c > 0)) & (t <= c)).all()
    few = pitman_yor.tables(np.full(4000, 10), np.full(4000, 2.0), 0.0, np.arange(4000, dtype=np.uint64) * np.uint64(77), 1)
    assert abs(few.mean() - sum(2 / (2 + i) for i in range(10))) < 0.1


def dictionary_model(texts, held, theta, samples, burn_in):
    """Log10 scores by dictionaries: restaurants by context, seated dish by dish in the same order of sweeps."""
    end = pitman_yor.END
    streams = [[*hash_words([t])[0].tolist(), int(end)] for t in texts]
    pair = lambda u, w: int(mix(np.array([u], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(w))[0] >> np.uint64(16))
    count, two = Counter(), Counter()
    for s, h in zip(streams, held, strict=True):
        if not h:
            count.update(s)
            two.update(zip([int(end), *s[:-1]], s, strict=True))
    n, v = sum(count.values()), len(count)
    ones, pairs = Counter(count.values()), Counter(two.values())
    d = min(0.95, max(0.05, pairs[1] / max(1.0, pairs[1] + 2 * pairs[2])))
    d0 = min(0.95, max(0.05, ones[1] / max(1.0, ones[1] + 2 * ones[2])))
    uniform = 1 / (v + 1)
    seat = lambda c, alpha, dd, key, kind: int(pitman_yor.tables(np.array([c]), np.array([alpha]), dd, np.array([key], dtype=np.uint64), kind)[0])
    own = {u: max(1, count[u]) ** 0.9 for s in streams for u in s}
    prob = lambda w: (count[w] + 0.5) / (n + 0.5 * (v + 1))
    states = []
    for kind in range(2, 2 + burn_in + samples):
        t = {(u, w): seat(c, (theta + d * own.get(u, 0)) * prob(w), d, pair(u, w), kind) for (u, w), c in two.items()}
        own, dish = Counter(), Counter()
        for (u, w), k in t.items():
            own[u] += k
            dish[w] += k
        top = {w: seat(k, (theta + d0 * v) * uniform, d0, w, kind) for w, k in dish.items()}
        total, tops = sum(dish.values()), sum(top.values())
        prob = lambda w, dish=dish, top=top, total=total, tops=tops: (dish[w] - d0 * top.get(w, 0) + (theta + d0 * tops) * uniform) / (theta + total)
        if kind >= 2 + burn_in:
            states.append((t, own, prob))

    def predict(u, w):
        return sum((max(0, two[u, w] - d * t.get((u, w), 0)) + (theta + d * own[u]) * p(w)) / (theta + count[u]) for t, own, p in states) / samples

    scores = [sum(math.log10(predict(u, w)) for u, w in zip([int(end), *s[:-1]], s, strict=True)) for s in streams]
    return scores, predict, list(count)


def test_pitman_yor_against_dictionaries(spark):
    tune(spark)
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(40)], k=r.choice([0, 1, 30, 200]))) for _ in range(60)] + ["unseen words here", "the " * 3000]
    held = [i % 7 == 2 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, held, ["x"] * len(texts), strict=True)), "doc_id long, text string, held_out boolean, block string").repartition(3)
    want, predict, vocab = dictionary_model(texts, held, pitman_yor.THETA, pitman_yor.SAMPLES, pitman_yor.BURN_IN)
    for u in (vocab[0], vocab[5], int(pitman_yor.END)):
        assert math.isclose(sum(predict(u, w) for w in vocab) + predict(u, 12345), 1, rel_tol=1e-9)
    got = {x["doc_id"]: x for x in pitman_yor.score(df).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert math.isclose(got[i]["score"], w, rel_tol=1e-9)


def seated(c, alpha, d, n, r):
    out = []
    for _ in range(n):
        t, u = 1, r.random(c)
        for i in range(1, c):
            t += u[i] * (alpha + i - d * t) < alpha
        out.append(t)
    return np.array(out)


@pytest.mark.parametrize("c, alpha, d", [(10, 2.0, 0.5), (200, 0.3, 0.6), (200, 5.0, 0.6), (2000, 1.5, 0.7), (2000, 90.0, 0.7), (2000, 400.0, 0.7)])
def test_tables_follow_the_restaurant(c, alpha, d):
    """Mean and spread of the tables are those of customers seated one by one."""
    r = np.random.default_rng(c)
    a, b = seated(c, alpha, d, 300, r), pitman_yor.tables(np.full(3000, c), np.full(3000, alpha), d, r.integers(0, 1 << 63, 3000, dtype=np.uint64), 3)
    assert abs(a.mean() - b.mean()) < 4 * a.std() / math.sqrt(300) + 0.02 and 0.8 < b.std() / a.std() < 1.25


def test_block_arrays():
    a = np.array([1, 5, 900, 1 << 60], dtype=np.uint64)
    assert np.array_equal(pitman_yor.expand_keys(pitman_yor.squeeze_keys(a)), a)
    assert pitman_yor.cuts(a, 4, 64).tolist() == [0, 4, 4, 4, 4]


def test_toxicity(spark):
    tune(spark)
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op9_toxicity(spark, sf)
    x = out.join(labels.where("toxic is not null"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in x) / len(x) > 0.9
    assert out.count() == docs.count() and out.where("score < 0 or score > 1").count() == 0
    model = toxicity.fit(docs, labels)
    # The same by dictionaries over the full vocabulary.
    texts = {d["doc_id"]: d["text"] or "" for d in docs.select("doc_id", "text").collect()}
    split = lambda t: Counter(re.findall(rb"[a-z0-9_\x80-\xff]+", lower(t).encode()))
    df = Counter(w for t in texts.values() for w in split(t))
    lab = {d["doc_id"]: d["toxic"] for d in labels.where("toxic is not null").collect() if d["doc_id"] in texts and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2}
    assert sorted(model.ids.tolist()) == sorted(lab)
    bags = {i: split(texts[i]) for i in lab}
    with_, toxic = Counter(w for b in bags.values() for w in b), Counter(w for i, b in bags.items() if lab[i] for w in b)
    n, m1 = len(lab), sum(lab.values())
    m0 = n - m1

    def vector(bag):
        out = {}
        for w, k in bag.items():
            a, both = toxic[w], with_[w]
            if 0 < both < n:
                chi2 = n * (a * (m0 - both + a) - (both - a) * (m1 - a)) ** 2 / (both * (n - both) * m1 * m0)
                out[w] = (1 + math.log(k)) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) * chi2
        size = math.sqrt(sum(x * x for x in out.values()))
        return {w: x / size for w, x in out.items()} if size else {}

    known = {i: vector(b) for i, b in bags.items()}
    some = random.Random(1).sample(list(texts.values()), 60) + [""]
    at, s, _ = model.nearest(some)
    for k, t in enumerate(some):
        v = vector(split(t))
        want = sorted((sum(x * e.get(w, 0.0) for w, x in v.items()) for e in known.values()), reverse=True)[: model.k]
        assert np.allclose(s[k], want, atol=1e-5)
    twice = spark.createDataFrame([(1, some[0]), (1, some[0]), (2, some[0] + " " + " ".join(f"long{i}" for i in range(300_000)))], "score long, text string").withColumnRenamed("score", "doc_id").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    got = toxicity.score(twice, model).orderBy("doc_id").collect()
    assert got[0] == got[1] and got[2]["score"] == got[0]["score"] and got[2]["neighbours"] == got[0]["neighbours"]
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "idiot")], "doc_id long, text string")
    assert len({r["score"] for r in toxicity.score(odd, model).where("doc_id is not null").collect()}) == 1
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert [r["score"] for r in toxicity.score(odd, none).collect()] == [0.0] * 3


def greedy(item, doc, least):
    """Greedy string tiling by its definition."""
    mi, md, out = [False] * len(item), [False] * len(doc), 0
    while True:
        best = []
        size = least - 1
        for p in range(len(item)):
            for q in range(len(doc)):
                k = 0
                while p + k < len(item) and q + k < len(doc) and item[p + k] == doc[q + k] and not mi[p + k] and not md[q + k]:
                    k += 1
                if k > size:
                    size, best = k, [(p, q)]
                elif k == size and k >= least:
                    best.append((p, q))
        if not best:
            return out
        for p, q in best:
            if not any(mi[p : p + size]) and not any(md[q : q + size]):
                mi[p : p + size] = md[q : q + size] = [True] * size
                out += size


def test_tiling():
    r = random.Random(8)
    for _ in range(120):
        item = np.array(r.choices(range(4), k=r.randint(3, 24)))
        doc = np.array(r.choices(range(4), k=r.randint(3, 40)))
        got = decontamination.tiles(item, doc, 3)
        assert sum(t[2] for t in got) == greedy(item.tolist(), doc.tolist(), 3)
        for p, q, n in got:
            assert np.array_equal(item[p : p + n], doc[q : q + n])


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_decontamination(spark, bound):
    tune(spark)
    w = [f"w{i}" for i in range(40)]
    item = " ".join(w)
    docs = [(1, "x y " + item + " z"), (2, " ".join(w[20:] + ["q"] + w[:20])), (3, " ".join(w[:20])), (4, None), (5, ""), (None, item), (1, "x y " + item + " z"), (6, "W0 " + " ".join(w[1:]).upper())]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (None, item), (7, "w1")], "item_id long, text string")
    got = decontamination.decontaminate(d, b, broadcast_words=bound).collect()
    assert len(got) == len(docs)
    assert sorted((r["doc_id"] or -1, r["contaminated"], round(r["max_coverage"], 3)) for r in got) == [(-1, True, 1.0), (1, True, 1.0), (1, True, 1.0), (2, True, 1.0), (3, False, 0.5), (4, False, 0.0), (5, False, 0.0), (6, True, 1.0)]
    assert {tuple(r["items"]) for r in got if r["contaminated"]} == {(7,)}
    assert decontamination.decontaminate(d.limit(0), b, broadcast_words=bound).count() == 0
    assert decontamination.decontaminate(d, b.limit(0), broadcast_words=bound).where("contaminated").count() == 0


def test_pipeline(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert 0 < after.count() <= docs.count()
        if name != "bpe_encoding":
            assert after.dtypes == docs.dtypes
        docs = after
    assert docs.count() < before and docs.where("size(ids) <> n_tokens").count() == 0


def odd_documents(spark):
    """Documents with null ids and texts, repeated rows, one id for different texts, a text of 5 MB and columns named like those that operators add."""
    r = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    long = " ".join(f"l{r.randrange(10**7)}" for _ in range(600_000))
    more = [(None, None), (None, "plain words of a text"), (None, item), (70_001, None), (70_001, None), (70_002, ""), (70_003, "some quiet text of its own"), (70_003, "some quiet text of its own"), (70_003, item), (70_004, "another quite different text"), (70_005, long)]
    out = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    for c in ("_id", "_th", "_cuts", "_gone", "_bad", "gone_id", "gone_text", "passage_id", "PASSAGE_CUTS", "contaminated_text", "th", "set", "key", "n", "component_id", "score"):
        out = out.withColumn(c, F.lit(c))
    return out, item, long


def test_stages_on_odd_documents(spark):
    tune(spark)
    docs, item, long = odd_documents(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), SF).count() == 0
        got = stage(spark, docs, SF)
        if k == 4:
            assert got.count() == docs.count()
            continue
        assert got.dtypes == docs.dtypes
        rows = Counter((x["doc_id"], x["text"]) for x in got.select("doc_id", "text").collect())
        assert rows[70_005, long] == 1 and rows[70_004, "another quite different text"] == 1
        assert rows[None, "plain words of a text"] == 1 and rows[70_003, "some quiet text of its own"] == (1 if name == "minhash_near_dedup" else 2)
        if name == "benchmark_decontamination":
            assert not rows[70_003, item] and not rows[None, item]
        if name == "minhash_near_dedup":
            assert rows[None, None] == 1 and rows[70_001, None] == 2 and rows[None, item] == 1


class Scale:
    """Stands for a model: texts that are scored with over 200,000 characters at once count as toxic."""

    def scores(self, texts):
        return np.full(len(texts), float(sum(map(len, texts)) > 200_000)), None, None, None


def test_toxic_rows_go_in_small_portions(spark):
    """A stage of a larger job scores small portions of a batch, and still every row."""
    tune(spark)
    rows = spark.createDataFrame([(k, chr(97 + k % 26) * 2000) for k in range(500)], "doc_id long, text string").coalesce(1)
    assert sorted(x["doc_id"] for x in toxicity.drop_toxic(rows, Scale()).collect()) == list(range(500))


def test_seats_of_some_pairs(spark, monkeypatch):
    """Tables of a dish don't depend on which others are drawn, so a sweep draws those of its block's own pairs alone; and the shuffle that deals out blocks is let go before the counts."""
    r = np.random.default_rng(4)
    c, alpha, seed = r.integers(0, 400, 3000), r.random(3000) * 9, r.integers(0, 1 << 63, 3000).astype(np.uint64)
    some = np.flatnonzero(r.random(3000) < 0.3)
    assert (pitman_yor.tables(c, alpha, 0.6, seed, 2)[some] == pitman_yor.tables(c[some], alpha[some], 0.6, seed[some], 2)).all()
    events = []
    free, put = pitman_yor.collected, pitman_yor.stored
    monkeypatch.setattr(pitman_yor, "collected", lambda s: (events.append("collected"), free(s))[1])
    monkeypatch.setattr(pitman_yor, "stored", lambda d, name: (events.append(name), put(d, name))[1])
    docs = spark.createDataFrame([(i, f"a b c{i % 3} a b", i % 4 == 0) for i in range(20)], "doc_id long, text string, held_out boolean")
    assert pitman_yor.score(docs).count() == 20
    assert events[:3] == ["model-blocks-raw", "collected", "model-counts"]
