"""Deduplication operators against brute force."""

import hashlib
import os
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import compact_windows, minhash, multi_index, suffix_dedup
from quillspark.llm.common import tune
from quillspark.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Random word salads with copies, edits, shared passages, and odd rows."""
    tune(spark)
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    texts = [" ".join(make(r.randint(1, 160))) for _ in range(60)]
    base, passage = make(120), " ".join(make(70))
    for k in range(40):
        w = list(base)
        for _ in range(r.choice([0, 2, 5, 9, 14])):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [" ".join(make(30)) + " " + passage + " " + " ".join(make(30)) for _ in range(20)]
    texts += [None, "", "   ", "one", "ONE", "a b", "z" * 2500, "Wort " * 300]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, texts[5], "s")], "doc_id long, text string, component_id string").repartition(3)


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(docs, width):
    sets = {}
    for r in docs.where("doc_id is not null").collect():
        w = WORD.findall(lower(r["text"]))
        sets[r["doc_id"]] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = minhash.near_duplicates(docs, width).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(docs.limit(0), width).count() == 0
    kept = minhash.keep_one(docs, width)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({i for i in want if want[i] == i})


def test_superminhash_estimates():
    r = np.random.default_rng(1)
    e = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = e[:2000], e[500:2500]
    sig = minhash.superminhash(np.concatenate((a, b)), np.repeat([0, 1], 2000), 2, 128)
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.15
    again = minhash.superminhash(np.concatenate((a[::-1], a[:7])), np.zeros(2007, dtype=np.int64), 1, 128)
    assert np.array_equal(again[0], sig[0])


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)]
    ids = {x for p in links for x in p}
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components(ids, links)


def strip_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        m = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                m[p] += 1
                m[p + length] -= 1
        gone = np.cumsum(m[:-1]) > 0
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("group", [256, 1])
def test_suffix_dedup(docs, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "SHARE", 3)
    rows = docs.collect()
    want = sorted(zip([-1 if r["doc_id"] is None else r["doc_id"] for r in rows], strip_repeats([r["text"] for r in rows], 320), strict=True))
    got = suffix_dedup.remove_repeats(docs, 320).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == want
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_deep_shallow():
    r = random.Random(3)
    for _ in range(300):
        pre = bytes(r.choices(b"ab", k=r.choice([0, 5, 60])))
        s = [pre + bytes(r.choices(b"ab", k=r.choice([0, 1, 3, 40, 45]))) for _ in range(r.randint(1, 12))]
        order, lcp = suffix_dedup.deep_shallow(s, len(pre), r.choice([0, 8, 32]))
        assert [s[i] for i in order] == sorted(s) and sorted(order) == list(range(len(s)))
        m = suffix_dedup.pairwise(order, lcp)
        assert all(m[i, j] == len(os.path.commonprefix([s[i], s[j]])) for i in range(len(s)) for j in range(len(s)) if i != j)


def test_multi_index(spark):
    r = np.random.default_rng(2)
    rows = []
    for c in range(40):
        centre = r.standard_normal(16)
        for _ in range(r.integers(1, 12)):
            v = centre + r.standard_normal(16) * r.choice([0.0, 0.05, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(c % 3)))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1), (None, rows[0][1], 0), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: (np.array(v), lab) for i, v, lab in rows[: n + 7] if v and None not in v and np.isfinite(v).all() and any(v) and lab is not None}
    cos = lambda a, b: len(a) == len(b) and float(a @ b / np.sqrt((a @ a) * (b @ b))) >= 0.93
    links = [(a, b) for a in good for b in good if a != b and good[a][1] == good[b][1] and cos(good[a][0], good[b][0])]
    comp = components(range(n + 7), links)
    n_links = Counter(a for a, _ in links)
    got = multi_index.near_vectors(df).collect()
    assert len(got) == len(rows)
    for x in got:
        if x["vec_id"] is not None:
            assert (x["n_links"], x["component_id"], x["kept"]) == (n_links[x["vec_id"]], comp[x["vec_id"]], comp[x["vec_id"]] == x["vec_id"])
    assert multi_index.near_vectors(df.limit(0)).count() == 0


def test_multi_index_shelves(spark, monkeypatch):
    """A vector is sent once for each shelf, not for each cell within reach; links are those of all pairs."""
    monkeypatch.setattr(multi_index, "BLOCK", 40)
    monkeypatch.setattr(multi_index, "TILE", 16)
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 8))
    x[100:140] = x[:40] + 0.05 * r.standard_normal((40, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    book = multi_index.fit(u, np.zeros(300, dtype=int), 8, 0.93, 0.9999)
    firsts = sorted({0, 9, 20, 41})
    for cells, shelves in zip(book.visits(u), book.visits(u, firsts), strict=True):
        assert shelves == sorted({sum(f <= c for f in firsts) - 1 for c in cells})
    got = multi_index.near_vectors(spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    links = (u @ u.T >= 0.93) & ~np.eye(300, dtype=bool) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)
    assert {g["vec_id"]: g["n_links"] for g in got} == dict(enumerate(links.sum(1).tolist())) and links.any()


def test_compact_windows_cover():
    """Every run of at least `least` places lies in exactly one window, and that has its least hash."""
    r = np.random.default_rng(3)
    h = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    l, c, w = compact_windows.compact_windows(h, np.array([0, 25]), np.array([25, 60]), 6)
    for lo, hi in ((0, 25), (25, 60)):
        for i in range(lo, hi):
            for j in range(i + 5, hi):
                inside = np.flatnonzero((l <= i) & (c >= i) & (c <= j) & (w >= j))
                assert len(inside) == 1 and c[inside[0]] == i + int(np.argmin(h[i : j + 1]))


def test_passages(docs):
    seen: dict = {}
    want = set()
    for r in docs.where("doc_id is not null").orderBy("doc_id").collect():
        w = WORD.findall(lower(r["text"]))
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        if any(seen.get(x, r["doc_id"]) != r["doc_id"] for x in runs):
            want.add(r["doc_id"])
        for x in runs:
            seen.setdefault(x, r["doc_id"])
    rows = compact_windows.passage_report(docs).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"] for r in rows if r["n_passages"]}
    assert want <= got
    left = {r["doc_id"]: r["text"] for r in compact_windows.remove_passages(docs).where("doc_id is not null").collect()}
    runs = defaultdict(set)
    for i, t in left.items():
        w = WORD.findall(lower(t))
        for k in range(len(w) - 49):
            runs[tuple(w[k : k + 50])].add(i)
    assert not [v for v in runs.values() if len(v) > 1]
    assert all(left[i] == r["text"] for r in docs.collect() if (i := r["doc_id"]) is not None and i not in got)
    assert compact_windows.passage_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words, changed", [(50, [25]), (50, [10]), (50, [16]), (60, [30]), (70, [35]), (80, [40]), (89, [44]), (120, [40, 80]), (120, [60]), (50, [2]), (60, [20, 40])])
def test_passages_cross_changes(words, changed):
    """A near copy is found from any shared place just where brute force has a run of enough shingles and similarity around it."""
    r = np.random.default_rng(words + sum(changed))
    a = r.integers(0, 1 << 60, words + 120, dtype=np.uint64)
    b = r.integers(0, 1 << 60, words + 120, dtype=np.uint64)
    b[60 : 60 + words] = a[60 : 60 + words]
    b[60 + np.array(changed)] = 1
    a, b = (compact_windows.shingle(x, 5)[: len(x) - 4] for x in (a, b))
    same = np.concatenate(([0], np.cumsum(a == b)))
    n = len(a)
    good = np.zeros(n, dtype=bool)
    for i in range(n):
        for j in range(i + 45, n):
            k = same[j + 1] - same[i]
            if k >= 0.8 * (2 * (j - i + 1) - k):
                good[i : j + 1] = True
    assert good.any() == (words != 60 or len(changed) == 1)
    for c in np.flatnonzero(a == b).tolist():
        assert bool(compact_windows.passages(a, b, [(c, 0, n - 1, c, 0, n - 1)])) == good[c]


@pytest.mark.parametrize("block", [256, 2])
def test_passages_behind_weaker_ones(spark, block, monkeypatch):
    """Earlier documents with parts of a passage don't hide that two later ones have all of it."""
    monkeypatch.setattr(compact_windows, "BLOCK", block)
    tune(spark)
    r = random.Random(5)
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, twice = [], {}
    for k in range(30):
        p = make(60)
        for part in (p[:40], p[20:], p, p):
            twice[len(rows)] = part is p and len(rows) % 4 == 3
            rows.append((len(rows), " ".join(make(60) + part + make(60))))
    got = {x["doc_id"]: x for x in compact_windows.passage_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_passages"] >= 1 and got[i]["n_repeated_words"] >= 60 and i - 1 in got[i]["partners"] for i in twice if twice[i])
    assert not any(got[i]["n_passages"] for i in twice if i % 4 < 2)


def test_repetitive_passages_behind_weaker_ones(spark):
    """Passages of two phrases, each said twice, have few distinct shingles; the second exact copy is found behind documents with parts of it."""
    tune(spark)
    r = random.Random(21)
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, second = [], []
    for _ in range(50):
        x, y = make(15), make(15)
        p = x + y + x + y
        for part in (p[:40], p[20:], p, p):
            rows.append((len(rows), " ".join(make(60) + part + make(60))))
        second.append(len(rows) - 1)
    got = {x["doc_id"]: x["n_passages"] for x in compact_windows.passage_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] > 0 for i in second) >= 0.95 * len(second)


def test_shared_bits():
    """The least number of shared bits against all runs, with and without repetition."""
    r = np.random.default_rng(3)
    n = compact_windows.LEAST
    for period in (200, 31, 12):
        s = np.tile(r.integers(0, 1 << 16, period), 10)[:91].astype(np.uint16)
        at = 45
        runs = [s[i : i + n] for i in range(91 - n + 1) if i <= at < i + n]
        want = min(len(set((x % compact_windows.LOOK).tolist())) - len(set(x.tolist())) // 9 for x in runs) - 2
        assert compact_windows._shared(s, at) == min(compact_windows.COMMON, want)


def test_large_groups_meet_in_bounded_memory():
    """Pairs of a large group of windows that are nearly alike, none of which holds a passage of another, are looked at in portions; they are many, and all are looked at."""
    r = np.random.default_rng(8)
    base, n = r.integers(0, 1 << 16, 91), 500
    # The place itself is another one in each, so that no pair is found and every pair is tried.
    sets = [np.concatenate((base[:45], [k], base[46:])).astype(np.uint16) for k in range(n)]
    two = [*sets, sets[0]]
    args = lambda x: (np.zeros(len(x), dtype=np.int64), np.arange(len(x)), np.full(len(x), -1), np.ones(len(x), dtype=bool), x, np.full(len(x), 45))
    tracemalloc.start()
    try:
        assert compact_windows._meet(*args(sets)) == []
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert compact_windows._meet(*args(two)) == [(n, 0)]
    assert peak < 64 << 20


def test_forest_lowest_band(spark):
    """A lower band whose slots are equal only in the sketches' bytes doesn't take a pair away from the bucket it shares."""
    tune(spark)
    sketch, part = bytes(128), np.arange(100, dtype="<u4").tobytes()
    bands = lambda k: [1000 + k if b < 3 else b for b in range(32)]
    rows = [(3, 3, k, k, bytearray(sketch), bands(k), 100, bytearray(part), 2) for k in (1, 2)]
    members = spark.createDataFrame(rows, "bucket long, band int, id long, component long, sketch binary, bands array<long>, n long, set binary, size long")
    assert [tuple(x) for x in minhash._forest(members, 80).collect()] == [(1, 2)]


def passage_like(a, b):
    """Whether two passages (lists of words) of equal place are as similar as asked, by their sets of shingles."""
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) >= 0.8 * len(x | y)


@pytest.fixture(scope="module")
def near_passages():
    """Pairs of 70-word passages one word apart, and chains in which each is one word from its parent; all amid other words, in random order."""
    r = random.Random(11)
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    groups = []
    for _ in range(400):
        p = make(70)
        q = list(p)
        q[r.randrange(70)] = "changed"
        groups.append([p, q])
    for _ in range(20):
        chain = [make(70)]
        for _ in range(38):
            q = list(chain[-1])
            q[r.randrange(70)] = f"x{r.randrange(10**6)}"
            chain.append(q)
        groups.append(chain)
    rows = [(g, p) for g, ps in enumerate(groups) for p in ps]
    r.shuffle(rows)
    want, seen, earlier = set(), defaultdict(list), {}
    for i, (g, p) in enumerate(rows):
        if any(passage_like(p, q) for q in seen[g]):
            want.add(i)
        earlier[i] = (p, list(seen[g]))
        seen[g].append(p)
    return [(i, " ".join(make(60) + p + make(60))) for i, (_, p) in enumerate(rows)], want, {i for i, (g, _) in enumerate(rows) if g < 400}, earlier


def test_near_passages_are_found(spark, near_passages):
    """Recall against brute force of at least 0.95, in pairs and in chains; what else is flagged has a shorter run that is similar enough."""
    tune(spark)
    rows, want, pairs, earlier = near_passages
    got = {x["doc_id"] for x in compact_windows.passage_report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x["n_passages"]}
    for some in (want & pairs, want - pairs):
        assert len(got & some) >= 0.95 * len(some)
    for i in got - want:
        p, others = earlier[i]
        assert any(passage_like(p[x:y], q[x:y]) for q in others for x in range(21) for y in range(x + 50, 71))
