"""Indexes and queues in a commit log: duplicates in batches, durable jobs; completion and SQL functions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions.register import register
from quillspark.operators import cache, completion, dedup, evaluation, rag, suggest
from quillspark.operators.duplicate_index import DuplicateIndex
from quillspark.streaming.durable import DurableQueue, Lost

DOCS = "doc_id long, text string"


def texts(n, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            t = list(r.choice(out)[1] or "x")
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = r.choice("ABCXYZ")
            out.append((i, "".join(t)))
        else:
            out.append((i, "".join(r.choice("abcdefghij klmnopqrst") for _ in range(200))))
    return out


def test_duplicates_in_batches(spark, tmp_path):
    """The same documents are kept as by one pass over all; a batch sent again changes nothing."""
    rows = [*texts(90), (90, ""), (91, None), (92, "")]
    df = spark.createDataFrame(rows, DOCS)
    want = {r["doc_id"]: r["kept"] for r in dedup.handle(df, "skip").collect()}
    assert 20 < sum(want.values()) < 80
    index = DuplicateIndex(spark, str(tmp_path))
    for lo, hi in ((0, 40), (40, 41), (41, 93), (0, 40)):
        index.take(df.where(f"doc_id >= {lo} and doc_id < {hi}"))
    got = index.read("decisions").collect()
    assert {r["doc_id"]: r["kept"] for r in got} == want and len(got) == len(rows)
    kept = {i for i, k in want.items() if k}
    assert all(r["canonical_doc_id"] in kept and r["similarity"] >= 0.9 for r in got if not r["kept"])
    assert index.size() == len(kept - {90, 91, 92})
    # A new handle reads the stored index; another threshold is refused.
    again = DuplicateIndex(spark, str(tmp_path))
    new = again.take(spark.createDataFrame([(200, rows[0][1]), (201, rows[0][1] + " "), (202, None)], DOCS)).collect()
    assert {r["doc_id"]: (r["kept"], r["canonical_doc_id"]) for r in new} == {200: (False, 0), 201: (False, 0), 202: (True, None)}
    with pytest.raises(ValueError, match="threshold"):
        DuplicateIndex(spark, str(tmp_path), 0.8)
    again.remove(spark.createDataFrame([(0,), (200,)], "doc_id long"))
    assert again.take(spark.createDataFrame([(300, rows[0][1])], DOCS)).collect()[0]["canonical_doc_id"] != 0
    assert again.take(spark.createDataFrame([], DOCS)).count() == 0


def test_duplicates_in_blocks(spark, monkeypatch):
    """Buckets are compared in blocks: each pair of distinct signatures once, with either side's copies told afterwards, the same as all pairs that share a band."""
    monkeypatch.setattr(dedup, "BLOCK", 7)
    monkeypatch.setattr(dedup, "TILE", 3)
    s = dedup.fingerprints(spark.createDataFrame([*texts(70), (70, ""), (71, None)], DOCS)).localCheckpoint()
    sig = {r["doc_id"]: r["signature"] for r in s.collect() if r["signature"]}
    bands, rows = dedup.banding(0.9)
    first = {i for i in sig if not any(sig[j] == sig[i] for j in sig if j < i)}

    def pair(i, j):
        eq = [x == y for x, y in zip(sig[i], sig[j], strict=True)]
        return sum(eq) / 128 if any(all(eq[b * rows : (b + 1) * rows]) for b in range(bands)) else 0

    want = sorted((i, j, pair(i, j)) for i in sig for j in first if i != j and pair(i, j) >= 0.9)
    assert sorted(map(tuple, dedup.lookup(s, s, 0.9).collect())) == want and len(want) > 50
    some = s.where("doc_id % 3 = 0")
    assert sorted(map(tuple, dedup.lookup(some, s, 0.9).collect())) == [x for x in want if x[0] % 3 == 0]
    n = dedup.like(dedup._packed(s), None, 0.9).count()
    assert n == sum(i > j for i, j, _ in want if i in first)


def test_duplicates_of_a_stream(spark, tmp_path):
    """Files that arrive one after the other are decided as batches."""
    rows = texts(24, seed=5)
    df = spark.createDataFrame(rows, DOCS)
    index = DuplicateIndex(spark, str(tmp_path / "index"))
    for lo in (0, 12):
        df.where(f"doc_id >= {lo} and doc_id < {lo + 12}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(DOCS).parquet(str(tmp_path / "in"))
        q = index.stream(stream).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    want = {r["doc_id"]: r["kept"] for r in dedup.handle(df, "skip").collect()}
    assert {r["doc_id"]: r["kept"] for r in index.read("decisions").collect()} == want


def test_verified_pairs(spark):
    rows = [*texts(60), (60, ""), (61, None), (62, "ab"), (63, "AB "), (64, "abc")]
    sets = {}
    for i, t in rows:
        t = (t or "").lower().strip()
        sets[i] = frozenset(t[k : k + 3] for k in range(len(t) - 2)) or ({t} if t else frozenset())
    strip = {i: (t or "").lower().strip() for i, t in rows}
    first = {i for i in sets if not any(strip[j] == strip[i] for j in range(i))}
    like = lambda a, b: len(a & b) >= 0.9 * len(a | b) > 0
    want = {i: min(j for j in first if j < i and like(sets[i], sets[j])) for i in first if any(j < i and like(sets[i], sets[j]) for j in first)}
    got = {r["doc_id"]: r["match_id"] for r in dedup.verified(spark.createDataFrame(rows, DOCS), 0.9).collect()}
    assert got == want and len(want) > 5


@pytest.fixture
def clock():
    class Clock:
        now = 1000.0

        def __call__(self):
            return self.now

    return Clock()


def test_jobs_outlive_their_worker(spark, tmp_path, clock):
    """A second worker takes a job over when the first one's lease is over, and the first can't finish it any more."""
    one = DurableQueue(spark, str(tmp_path), lease=10, worker="one", clock=clock)
    job = one.enqueue("payload")
    assert one.claim()["job_id"] == job and one.claim() is None
    two = DurableQueue(spark, str(tmp_path), lease=10, worker="two", clock=clock)
    assert two.claim() is None
    clock.now += 5
    one.report(job, 40.0)
    clock.now += 8
    assert two.claim() is None  # the report renewed the lease
    clock.now += 3
    taken = two.claim()
    assert (taken["job_id"], taken["attempts"], taken["worker"], taken["progress"]) == (job, 2, "two", 40.0)
    for late in (lambda: one.complete(job), lambda: one.report(job, 50.0), lambda: one.fail(job, "late")):
        with pytest.raises(Lost):
            late()
    two.complete(job, "done")
    assert (one.get(job)["status"], one.get(job)["message"]) == ("completed", "done")
    assert one.counts() == {"pending": 0, "processing": 0, "completed": 1, "failed": 0, "cancelled": 0}


def test_one_of_two_workers_gets_a_job(spark, tmp_path, clock):
    """A claim worked out from an old state is made again, and finds the job taken."""
    one, two = (DurableQueue(spark, str(tmp_path), worker=w, clock=clock) for w in ("one", "two"))
    job = one.enqueue("x")
    jobs, first = one.jobs, []

    def slow(state=None):
        if not first:
            first.append(two.claim()["job_id"])
        return jobs(state)

    latest = one._latest

    def stale():
        out = latest()
        one._latest = latest
        slow()
        return out

    one._latest = stale
    assert one.claim() is None and first == [job] and one.get(job)["worker"] == "two"


def test_durable_run(spark, tmp_path, clock):
    q = DurableQueue(spark, str(tmp_path), retries=1, clock=clock)
    good, bad, gone = q.enqueue("good"), q.enqueue("bad"), q.enqueue("gone")
    assert q.cancel(gone) and not q.cancel(gone) and not q.cancel("unknown")
    seen = []

    def handler(payload, report):
        seen.append(payload)
        report(50.0)
        if payload == "bad":
            raise OSError("no")
        return payload.upper()

    assert q.run(handler) == 2 and q.get(bad)["status"] == "pending"
    assert q.run(handler) == 0  # it waits for its delay
    clock.now += 5
    assert q.run(handler) == 1
    assert sorted(seen) == ["bad", "bad", "good"] and q.get(bad)["message"] == "no" and q.get(good)["message"] == "GOOD"
    assert q.counts() == {"pending": 0, "processing": 0, "completed": 1, "failed": 1, "cancelled": 1}
    assert {r["job_id"] for r in q.list("cancelled").collect()} == {gone} and q.list().count() == 3
    running = q.enqueue("later")
    q.claim()
    assert q.cancel(running)
    with pytest.raises(Lost):
        q.report(running, 1.0)
    assert time.time() > clock.now


@pytest.fixture(scope="module")
def entries(spark):
    r = random.Random(4)
    rows = {"".join(r.choice("ab") for _ in range(r.randrange(1, 12))): r.randrange(1, 9) for _ in range(300)}
    rows |= {"a" * 24 + x: i for i, x in enumerate(("b", "bc", "bcd", "x", ""))} | {"ü" * 30: 3, "long " * 20: 2}
    return spark.createDataFrame([(k.strip(), v) for k, v in rows.items()] + [("", 5), (None, 1)], "query_text string, frequency long")


def test_completion(spark, entries, tmp_path):
    """The entries of the scan for prefixes of any length, and of all edit distances for typing errors."""
    completion.build(entries).save(str(tmp_path))
    index = completion.load(spark, str(tmp_path))
    real = entries.where("query_text <> ''")
    for text in ("a", "B", "ab", "abba ", "a" * 24, "a" * 24 + "b", "a" * 24 + "bc", "ü" * 25, "long long", "zz"):
        assert list(map(tuple, completion.prefix(index, text).collect())) == list(map(tuple, suggest.prefix(real, text).select("query_text", "frequency").collect())), text
    for text in ("abab", "bbbbbbbb", "a", "üü", "abbaabbaab", ""):
        for d in (0, 1, 2):
            near = F.levenshtein("query_text", F.lit(text))
            want = real.where(near <= d).where("length(query_text) <= 40").select("query_text", "frequency", near.alias("distance")).orderBy("distance", F.desc("frequency"), "query_text").limit(10)
            assert list(map(tuple, completion.typed(index, text, 10, d).collect())) == list(map(tuple, want.collect())), (text, d)
    assert index.prefixes.groupBy("prefix").count().agg(F.max("count")).collect()[0][0] <= completion.BEST
    for bad in (lambda: completion.prefix(index, " "), lambda: completion.prefix(index, "a", 50), lambda: completion.typed(index, "a", 5, 3)):
        with pytest.raises(ValueError):
            bad()
    assert completion.prefix(completion.build(entries.limit(0)), "a").count() == 0


def test_functions_in_sql(spark):
    register(spark)
    register(spark)
    spark.createDataFrame([(1, "One two. Three! Four? Five.\n\nNext."), (2, ""), (3, None)], DOCS).createOrReplaceTempView("sql_docs")
    rows = spark.sql("SELECT doc_id, c.* FROM sql_docs, LATERAL chunk_sentence(text, 2, 1) c ORDER BY 1, 2").collect()
    assert [(r["doc_id"], r["chunk_id"], r["content"], r["sentences"]) for r in rows] == [(1, 0, "One two. Three!", 2), (1, 1, "Three! Four?", 2), (1, 2, "Four? Five.", 2), (1, 3, "Five. Next.", 2), (1, 4, "Next.", 1)]
    assert spark.sql("SELECT count(*) FROM sql_docs, LATERAL chunk_sentence(text)").collect()[0][0] == 3
    assert spark.sql("SELECT doc_id, c.content FROM sql_docs, LATERAL chunk_paragraph(text, 1, 1000) c").collect()[0]["content"] == "One two. Three! Four? Five.\n\nNext."
    got = spark.sql("SELECT text_tokens('A b-c_1 É'), vector_cosine(array(1D, 0D), array(1D, 1D)), vector_cosine(array(0D), array(1D)), token_overlap('a b', 'B c'), fuzzy_ratio('abc', 'abd'), fuzzy_partial('ABC', 'xxabcxx'), token_overlap('', 'a')").collect()[0]
    assert got[0] == ["a", "b", "c_1"] and abs(got[1] - 0.5**0.5) < 1e-12 and got[2:4] == (0.0, 0.5) and abs(got[4] - 200 * 2 / 6) < 1e-9 and got[5:] == (1.0, 0.0)


def test_decisions_by_a_generator():
    """The generator sees the question and what was found, and its reply ends or continues the search."""
    seen, replies = [], ["search: young birds", "DONE"]

    def generate(prompt):
        seen.append(prompt)
        return replies.pop(0)

    out = rag.agentic(lambda q, k: [{"doc_id": len(q), "score": 0.5, "content": q.upper() + "." * 200}], "do birds fly", rag.decider(generate), generate=lambda p: "yes")
    assert out["searches"] == ["do birds fly", "young birds"] and len(out["sources"]) == 2 and out["answer"] == "yes"
    assert "do birds fly" in seen[0] and "DO BIRDS FLY" in seen[0] and "." * 101 not in seen[0]


def test_stats_of_an_external_cache():
    class Client(dict):
        def setex(self, key, ttl, value):
            self[key] = value

        def delete(self, key):
            return self.pop(key, None) is not None

        def scan_iter(self, pattern):
            return [k for k in self if k.startswith(pattern[:-1])]

    c = cache.PrefixCache(Client(other=1), "s:", 60)
    c.set("a", [1])
    assert (c.get("a"), c.get("b")) == ([1], None)
    assert c.stats() == {"size": 1, "prefix": "s:", "ttl": 60, "hits": 1, "misses": 1, "hit_rate": 0.5}


def test_summary_of_many_rows(spark):
    assert len(evaluation.summary(spark.range(1500)).split("\n")) == 1500


def test_sql_chunks_make_rows_where_the_text_lies(spark):
    register(spark)
    spark.createDataFrame([(1, "A b. C d! E. F?"), (2, ""), (3, None), (4, " \n "), (5, "A b. C d! E. F?")], "doc_id long, text string").createOrReplaceTempView("sql_few")
    out = spark.sql("SELECT doc_id, c.* FROM sql_few, LATERAL chunk_sentence(text) c")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted(map(tuple, out.collect())) == [(i, *c) for i in (1, 5) for c in ((0, "A b. C d! E.", 3), (1, "E. F?", 2))]


def test_candidates_of_one_cluster_get_a_text_once(spark, monkeypatch):
    """All pairs of 60 like texts and one short: the least matches are those of sets, in small blocks, too, and a text goes to few blocks."""
    rng = random.Random(2)
    base = [rng.choice("abcdefgh \U0001f600") for _ in range(400)]
    texts = {}
    for i in range(60):
        t = list(base)
        for _ in range(rng.randrange(12)):
            t[rng.randrange(400)] = rng.choice("xyz")
        texts[i] = "".join(t).strip() + str(i)
    texts[60] = "ab"
    grams = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in texts.items()}
    want = {}
    for i in range(60):
        for j in range(i):
            s = len(grams[i] & grams[j]) / len(grams[i] | grams[j])
            if s >= 0.9:
                want[i] = (j, s)
                break
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    met = spark.createDataFrame([(i, j) for i in range(61) for j in range(i)], "doc_id long, match_id long")
    for size in (512, 16):
        monkeypatch.setattr(dedup, "TEXTS", size)
        out = dedup.above(docs, met, 0.9)
        got = {}
        for r in sorted(map(tuple, out.collect())):
            got.setdefault(r[0], r[1:])
        assert got == want and 10 < len(want) < 60
