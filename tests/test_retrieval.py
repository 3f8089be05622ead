"""Indexes that read a part of the rows, against all pairs; the store under crashes and two writers; the watcher's late changes; recall of duplicates."""

import os
import random
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.fuzzy import Pattern, gram_bound, gram_codes, partial_ratio, partial_ratios, ratio
from quillspark.operators import blockmax, bm25, dedup, fusion, lexical, nearest, scan, vector_search
from quillspark.operators.providers import embed
from quillspark.plans.engine import Engine
from quillspark.sources import store
from quillspark.sources.scratch import place
from quillspark.streaming import stateful


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    text = lambda: " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(300)], k=r.randrange(0, 60)))
    return spark.createDataFrame([(i * 3 - 200, None if i == 5 else text()) for i in range(900)], "doc_id long, text string")


@pytest.mark.parametrize("rounds", [(4, 64), (1,), ()])
def test_blockmax(spark, docs, rounds, tmp_path):
    """The scores and documents of scoring all, ties, repeated words and unknown ones included; rare words let ranges unread."""
    q = spark.createDataFrame([(1, "w250 w299 w1"), (2, "w7 w7 w0"), (3, "nothing known"), (4, ""), (5, "w280")], "query_id long, query_text string")
    index = bm25.fit(docs)
    blockmax.build(index).save(str(tmp_path))
    got, report = blockmax.search(blockmax.load(spark, str(tmp_path)), q, 7, rounds=rounds)
    rows = lambda df: sorted((r["query_id"], r["doc_id"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert rows(got) == rows(fusion.top_per_query(bm25.score(index, q), 7))
    read = {r["query_id"]: r["read"] / r["postings"] for r in report.collect()}
    assert set(read) == {1, 2, 5}
    assert read[1] < 1 if rounds else read[1] == 1


def test_blockmax_blocks(spark, docs):
    b = blockmax.build(bm25.fit(docs))
    assert b.blocks.agg(F.max("n")).collect()[0][0] <= blockmax.RANGE
    assert b.blocks.where("size(docs) <> n or size(tfs) <> n or size(dls) <> n").count() == 0
    none = docs.limit(0)
    assert blockmax.top_k(blockmax.build(bm25.fit(none)), spark.createDataFrame([(1, "w1")], "query_id long, query_text string")).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    """Tight groups, zeros, copies, and some with no group."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(30, 12))
    x = np.concatenate([centres[np.arange(900) % 30] + r.normal(size=(900, 12)) * 0.05, r.normal(size=(60, 12)), np.zeros((3, 12)), np.repeat(centres[:1], 40, axis=0)])
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(5000, None)], "doc_id long, embedding array<double>")


def pairs(vectors):
    rows = [(r["doc_id"], np.array(r["embedding"])) for r in vectors.where("embedding is not null").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    n = np.sqrt((x * x).sum(1, keepdims=True))
    u = x / np.where(n == 0, 1, n)
    return ids, u @ u.T


def best_of(ids, scores, at, k):
    order = np.lexsort((ids, -np.round(scores[at], 9)))[:k]
    return [(int(ids[i]), round(float(scores[at, i]), 9)) for i in order]


@pytest.mark.parametrize("limit", [None, 10])
def test_nearest_and_cells(spark, vectors, limit, tmp_path):
    """Exact results by a pass and from an index of which a part was appended; other lengths and nulls; fewer files than all; recall of probes."""
    ids, scores = pairs(vectors)
    q = vectors.where("doc_id % 20 = 0 or doc_id in (961, 5000)").select(F.col("doc_id").alias("query_id"), "embedding")
    asked = [i for i in ids.tolist() if i % 20 == 0 or i == 961]
    want = {i: best_of(ids, scores, int(np.flatnonzero(ids == i)[0]), 5) for i in asked}

    def rows(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 9)))
        return out

    got = nearest.nearest(vectors, q, 5, limit)
    assert rows(got) == want and not re.search("NestedLoop|Cartesian|SortMergeJoin", plan(got))
    index = nearest.append(vectors.where("doc_id >= 700"), nearest.save(vectors.where("doc_id < 700"), str(tmp_path)))
    assert index.vectors().count() == len(ids)
    exact = nearest.search(index, q, 5, exact=True, limit=limit)
    assert rows(exact) == want and not re.search("NestedLoop|Cartesian", plan(exact))
    probed = rows(nearest.search(index, q, 5, limit=limit))
    found = [len({i for i, _ in probed[a]} & {i for i, _ in want[a]}) / 5 for a in asked if a < 900]
    assert np.mean(found) >= 0.9
    # One query's cells are read, not all folders.
    one = nearest.search(index, q.where("query_id = 40"), 5, exact=True)
    read = {c for c in re.findall(r"cell#\d+ IN \(([\d,]*)\)|\(cell#\d+ = (\d+)\)", plan(one)) for c in ",".join(filter(None, c)).split(",")}
    assert 0 < len(read) < len(index.centroids) / 2


def test_index_of_odd_vectors(spark, tmp_path):
    schema = "doc_id long, embedding array<double>"
    with pytest.raises(ValueError, match="at least one"):
        nearest.save(spark.createDataFrame([], schema), str(tmp_path / "a"))
    with pytest.raises(Exception, match="one length"):
        nearest.save(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema), str(tmp_path / "b"))
    one = nearest.save(spark.createDataFrame([(1, [0.0, 0.0])], schema), str(tmp_path / "c"))
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in nearest.search(one, q, 3, exact=True).collect()] == [(7, 1, 0.0)]
    assert nearest.nearest(spark.createDataFrame([], schema), q).count() == 0


@pytest.mark.parametrize(("size", "threshold"), [(1024, 0.9), (16, 0.9), (50, -0.2)])
def test_cosine_pairs(spark, vectors, size, threshold):
    """All pairs, in blocks of any size; groups far apart never meet."""
    ids, scores = pairs(vectors)
    a, b = np.nonzero(np.triu(scores >= threshold, 1))
    got = {(r["a"], r["b"]): r["score"] for r in vector_search.cosine_pairs(vectors, threshold, size).collect()}
    sure = {(int(ids[i]), int(ids[j])) for i, j in zip(a, b, strict=True) if abs(scores[i, j] - threshold) > 1e-9}
    assert sure <= set(got) and all(abs(scores[np.searchsorted(ids, i), np.searchsorted(ids, j)] - s) < 1e-9 for (i, j), s in got.items())


def test_blocks_that_never_meet(spark, vectors):
    """Blocks are small whatever the number of vectors, and most pairs of them are too far apart."""
    rows, centres = vector_search.blocks(vectors.where("doc_id < 900"), 16)
    n = centres.count()
    assert rows.groupBy("block").count().agg(F.max("count")).collect()[0][0] <= 4 * 16
    met = vector_search.block_pairs(centres, 0.95)
    print("met", met.count(), n * (n + 1) / 2)
    assert met.count() < 0.5 * n * (n + 1) / 2
    assert {tuple(r) for r in met.collect()} == {tuple(r) for r in vector_search.block_pairs(centres, 0.95, limit=7).collect()}


def test_partial_ratio():
    """Against every window; the bound from grams holds, and a floor only hides what is below it."""
    r = random.Random(1)
    for _ in range(400):
        abc = r.choice(["ab", "abcdef ", "abcdefghijklmnop é"])
        a, b = ("".join(r.choice(abc) for _ in range(r.randrange(0, n))) for n in (150, 260))
        s, t = (a, b) if len(a) <= len(b) else (b, a)
        m, n = len(s), len(t)
        every = [t[:k] for k in range(1, m)] + [t[i : i + m] for i in range(n - m + 1)] + [t[k:] for k in range(n - m + 1, n)]
        want = max(ratio(s, x) for x in every) if s else 0.0 if t else 100.0
        assert abs(partial_ratio(a, b) - want) < 1e-9
        assert gram_bound(m, n, np.unique(gram_codes(s)), gram_codes(t)) >= want - 1e-6
        assert abs(partial_ratio(a, b, want) - want) < 1e-9 and partial_ratio(a, b, want + 0.01) == -1.0
    long = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    assert partial_ratio("abc" * 30, long) == max(ratio("abc" * 30, long[i : i + 90]) for i in range(0, len(long) - 89)) or partial_ratio("abc" * 30, long) > 50


@pytest.mark.parametrize("portion", [2000, 1])
def test_hybrid_top_k(spark, portion):
    """The documents and scores of all pairs, with fewer comparisons."""
    r = random.Random(9)
    words = "alpha beta gamma delta fast slow engine search table row column index of the and to".split()
    rows = [(i, " ".join(r.choices(words, k=r.randrange(3, 60)))) for i in range(150)]
    rows += [(200, ""), (201, None), (202, "!!"), (203, "The FAST engine, of search"), (204, "the fast engine of serch")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(1, "the fast engine of search"), (2, "zeta"), (3, "?!"), (4, "alpha beta gamma delta alpha"), (5, "")], "query_id long, query_text string")
    want = fusion.top_per_query(lexical.hybrid_lexical(d, q), 4)
    got = lexical.hybrid_top_k(d, q, 4, portion=portion)
    key = lambda df: sorted((r["query_id"], r["doc_id"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert key(got) == key(want)
    assert got.where("query_id = 1").select("compared").first()[0] < len(rows) / 2


def new_store(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "store")).create()


ROWS = "content string, source_path string"


def contents(s):
    return [r["content"] for r in s.read("docs").orderBy("doc_id").collect()]


def test_store_after_a_crash(spark, tmp_path, monkeypatch):
    """A write that dies before its commit leaves nothing that is read and blocks nothing; its folders go later."""
    s = new_store(spark, tmp_path)
    s.replace(spark.createDataFrame([("one", "a")], ROWS))
    monkeypatch.setattr(store.Store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    for fails in (lambda: s.add(spark.createDataFrame([("two", "b")], ROWS)), lambda: s.write("docs", s.read("docs")), lambda: s.append("docs", s.read("docs"))):
        with pytest.raises(OSError, match="gone"):
            fails()
    monkeypatch.undo()
    assert contents(s) == ["one"]
    s.add(spark.createDataFrame([("two", "b")], ROWS))
    assert contents(s) == ["one", "two"] and s.read("embeddings").count() == 2
    with pytest.raises(Exception, match="boom"):  # dies while its rows are written
        s.write("docs", s.read("docs").withColumn("content", F.raise_error(F.lit("boom"))))
    assert contents(s) == ["one", "two"]
    assert s.vacuum() == 0
    assert s.vacuum(stay=-60) >= 5
    assert contents(s) == ["one", "two"] and s.all().count() == 2


def test_two_writers(spark, tmp_path):
    """No row is lost and no id is given twice; documents and vectors stay together."""
    s = new_store(spark, tmp_path)
    failed = []

    def work(name):
        mine = store.Store(spark, s.path)
        try:
            for i in range(3):
                mine.add(spark.createDataFrame([(f"{name} {i}", f"{name}{i}")], ROWS))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in ("x", "y")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert sorted(contents(s)) == sorted(f"{n} {i}" for n in "xy" for i in range(3))
    assert [r["doc_id"] for r in s.all().collect()] == list(range(6)) == sorted(r["doc_id"] for r in s.read("embeddings").collect())
    number, state = s._latest()
    assert not s._commit(number, state) and s._commit(number + 1, state)


def test_updates_start_from_the_newest(spark, tmp_path):
    """A change that was worked out from an old state is worked out again."""
    s = new_store(spark, tmp_path)
    s.replace(spark.createDataFrame([("one", "a"), ("two", "b")], ROWS))
    calls = []

    def step(docs):
        if not calls:
            store.Store(spark, s.path).set_metadata(spark.createDataFrame([(0, '{"k": 1}')], "doc_id long, metadata string"))
        calls.append(1)
        return docs.withColumn("language", F.lit("en"))

    s.update("docs", step)
    assert len(calls) == 2
    assert [(r["metadata"], r["language"]) for r in s.all().collect()] == [('{"k": 1}', "en"), (None, "en")]


def test_old_commits_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "COMMITS", 3)
    s = new_store(spark, tmp_path)
    for i in range(5):
        s.write("suggestions", spark.createDataFrame([(f"q{i}", i)], "query_text string, frequency long"))
    assert len(s.commits()) <= 4 and s.read("suggestions").collect()[0]["frequency"] == 4


def test_late_changes_are_reported(spark, tmp_path):
    """What happens within the gap is reported after it, and the store holds the last text."""
    folder = tmp_path / "files"
    s = new_store(spark, tmp_path)
    w = stateful.auto_index(spark, str(folder), s).start()

    def put(text):
        (folder / "a.txt").write_text(text)
        t = os.stat(folder / "a.txt").st_mtime + len(text)
        os.utime(folder / "a.txt", (t, t))

    put("one")
    assert [c for _, c in w.poll(100.0)] == ["created"]
    put("one two")
    (folder / "b.txt").write_text("b")
    assert [c for _, c in w.poll(101.0)] == ["created"]  # b; a waits
    assert contents(s) == ["one", "b"]
    assert [c for _, c in w.poll(110.0)] == ["modified"] and sorted(contents(s)) == ["b", "one two"]
    put("three")
    assert len(w.poll(120.0)) == 1
    os.remove(folder / "a.txt")
    assert w.poll(121.0) == [] and [c for _, c in w.poll(130.0)] == ["deleted"]
    assert contents(s) == ["b"] and w.poll(140.0) == []


def test_failed_changes_are_reported_again(spark, tmp_path):
    seen = []

    def fails(changes):
        seen.append(changes)
        if len(seen) == 1:
            raise OSError("no")

    w = stateful.FileWatcher(spark, str(tmp_path), fails, gap=0.0).start()
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(OSError):
        w.poll(1.0)
    assert w.poll(2.0) == seen[0] == seen[1]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 0.95])
def test_duplicate_recall(spark, threshold):
    """Pairs at or over a threshold by their true similarity, against brute force on the shingles."""
    r = random.Random(int(threshold * 100))
    rows, change = [], {0.5: 26, 0.8: 9, 0.9: 4, 0.95: 2}[threshold]
    for i in range(250):
        t = [r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(250)]
        rows.append((2 * i, "".join(t)))
        for _ in range(r.randrange(change + 1)):
            t[r.randrange(250)] = r.choice("ABC0123456789")
        rows.append((2 * i + 1, "".join(t)))
    grams = [{t.lower().strip()[k : k + 3] for k in range(len(t.strip()) - 2)} for _, t in rows]
    want = {2 * i for i in range(250) if len(grams[2 * i] & grams[2 * i + 1]) >= (threshold + 0.02) * len(grams[2 * i] | grams[2 * i + 1])}
    s = dedup.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"] for r in dedup.lookup(s, s, threshold - 0.03).where("match_id = doc_id - 1").select((F.col("doc_id") - 1).alias("doc_id")).collect()}
    assert len(want) > 60 and len(want & got) >= 0.95 * len(want)


def test_bands():
    for t in (0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0):
        bands, rows = dedup.banding(t)
        assert bands * rows <= dedup.PERMUTATIONS and (1 - t**rows) ** bands <= dedup.MISSED or rows == 1
    with pytest.raises(ValueError):
        dedup.banding(0)


def test_suggestions_are_summed(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    for text in ("Early bird", "early bird ", "late"):
        e.log_queries(spark.createDataFrame([(1, text)], "query_id long, query_text string"), 5, 0.7, 0.3)
    assert {r["query_text"]: r["frequency"] for r in e.suggestions().collect()} == {"early bird": 2, "late": 1}
    assert e.store.read("suggestions").count() == 3


def test_places_differ(spark):
    assert place(spark, "x") != place(spark, "x")


def test_nearest_in_bounded_products(spark, vectors, monkeypatch):
    """No product of a task has more elements than the bound, however many queries there are; results stay those of all pairs."""
    ids, scores = pairs(vectors)
    sizes = []
    best = nearest._best
    monkeypatch.setattr(nearest, "SCORES", 1000)
    monkeypatch.setattr(nearest, "HELD", 500)
    monkeypatch.setattr(nearest, "_best", lambda i, x, qi, q, k: (sizes.append(len(i) * len(q)), best(i, x, qi, q, k))[1])
    at = np.arange(len(ids))
    rows = {r["doc_id"]: r["embedding"] for r in vectors.where("embedding is not null").collect()}
    dim = len(rows[int(ids[0])])
    u = nearest.units([rows[i] for i in ids.tolist()], dim)
    batch = nearest.pa.RecordBatch.from_arrays([nearest.pa.array(ids), nearest.pa.array([rows[i] for i in ids.tolist()], nearest.pa.list_(nearest.pa.float64()))], ["doc_id", "embedding"])

    class Sent:
        value = (ids, u, None)

    got = {}
    for b in nearest._kernel(Sent, 5, False)([batch, batch.slice(0, 0)]):
        for q, d, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got.setdefault(q, []).append((d, round(s, 9)))
    for i in at[::37].tolist():
        assert sorted(got[int(ids[i])], key=lambda x: (-x[1], x[0])) == best_of(ids, scores, i, 5)
    assert len(sizes) > 10 and max(sizes) <= 1000


def test_bucket_pairs_are_not_shuffled(spark):
    """Pairs that share a bucket are those of a join on buckets, each once; only results above the threshold pass a shuffle."""
    r = np.random.default_rng(8)
    x = r.standard_normal((200, 6))
    x[150:] = x[:50] * 2
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)] + [(200, [0.0] * 6), (201, None)], "doc_id long, embedding array<double>")
    q = v.where("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    o = {"tables": 5, "bits": 3}
    index = vector_search.lsh_index(v, 6, **o)
    got = vector_search.lsh_query(index, q, 6, 0.5, limit=20, **o)
    asked = vector_search.lsh_index(q.withColumnRenamed("query_id", "doc_id"), 6, **o).select("table", "bucket", F.col("doc_id").alias("query_id"), F.col("embedding").alias("e"))
    want = asked.join(index, ["table", "bucket"]).dropDuplicates(["query_id", "doc_id"]).where(vector_search.cosine(F.col("embedding"), F.col("e")) >= 0.5)
    rows = [(a["query_id"], a["doc_id"]) for a in got.collect()]
    assert sorted(rows) == sorted((a["query_id"], a["doc_id"]) for a in want.collect()) and len(rows) > 100
    assert not re.search("Join", plan(got))


def test_partial_ratios_of_many_texts():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcde fgh éß\U0001f600") for _ in range(n))
    for q in ("the thand of and pathetic", "ab", "a", "", some(105)):
        texts = [some(rng.choice((0, 1, 5, 24, 25, 26, 60, 300))) for _ in range(100)] + [q, q + "a", "zz" + q, q[1:], "z" * 40]
        assert partial_ratios(Pattern(q), texts).tolist() == [partial_ratio(q, t) for t in texts]


@pytest.mark.parametrize("portion", [1, 2000])
def test_scan_scores_each_pair_in_one_pass(spark, monkeypatch, portion):
    """Same scores as the joins of all pairs; a text is embedded once, however many parts the queries have."""
    monkeypatch.setattr(scan, "PORTION", portion)
    texts = ["early bird gets", "the worm.", "", None, "Bird of the rows " * 30, "..."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame([(1, "early bird"), (2, "!"), (3, None)], "query_id long, query_text string").repartition(3)
    e = lambda x: x.select(x.columns[0], embed(x.columns[1]).alias("embedding"))
    sem = vector_search.cosine_scores(e(d), e(q.select("query_id", F.col("query_text"))))
    lex = lexical.hybrid_lexical(d, q.fillna(""))
    want = {(r["query_id"], r["doc_id"]): (r["s"], r["l"]) for r in sem.withColumnRenamed("score", "s").join(lex.withColumnRenamed("score", "l"), ["query_id", "doc_id"]).collect()}
    out = scan.scores(d, q)
    got = {(r["query_id"], r["doc_id"]): (r["s"], r["l"]) for r in out.collect()}
    assert len(want) == 18 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_blocks_take_one_shuffle_of_tokens(spark, docs):
    made, same = blockmax.build(bm25.fit(docs, by_term=True)), blockmax.build(bm25.fit(docs))
    assert plan(made.blocks).count("Exchange hashpartitioning") == 1
    row = lambda r: (r["term"], r["block"], r["n"], round(r["top"], 9), r["docs"], r["tfs"], r["dls"])
    assert sorted(map(row, made.blocks.collect())) == sorted(map(row, same.blocks.collect()))
    path = place(spark, "by-term")
    made.save(path)
    got = blockmax.load(spark, path).blocks.withColumn("file", F.input_file_name()).groupBy("term").agg(F.count_distinct("file").alias("n"))
    assert got.where("n > 1").count() == 0


def test_vectors_of_pairs_are_sent_to_few_tasks(spark, vectors):
    """Blocks lie on shelves, and a vector goes to a pair of shelves once, not to every pair of blocks."""
    rows, centres = vector_search.blocks(vectors, 16)
    shelves = centres.select("shelf").distinct().count()
    assert 2 <= shelves <= 3 * vector_search.SHELVES < centres.count()
    assert rows.groupBy("shelf").count().agg(F.max("count")).collect()[0][0] <= 2 * rows.count() / vector_search.SHELVES + 16
    got = vector_search.cosine_pairs(vectors, 0.9, 16)
    text = got._jdf.queryExecution().toString()
    assert "shelf" in text and not re.search(r"FlatMapGroupsInArrow \[i#", text)
    # A cell larger than a shelf lies on several.
    first, many = vector_search._shelves(np.eye(3), np.array([10, 95, 7]), 20)
    assert many.tolist() == [1, 5, 1] and sorted([first[0], first[1], first[2]])[0] == 0
