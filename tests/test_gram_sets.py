"""Near duplicates decided on the sets themselves, against all pairs."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillspark.operators import dedup, gram_sets
from quillspark.sources import scratch

DOCS = "doc_id long, text string"


def alike(n, seed=3, least=700, most=1500):
    """Long texts over few letters: nearly all pairs have most trigrams in common; some with letters of other alphabets, short ones, copies."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = "".join(r.choice("abcdefgh ") for _ in range(r.randrange(least, most)))
        if out and i % 3 == 0:
            t = list(r.choice(out))
            for _ in range(r.randrange(40)):
                t[r.randrange(len(t))] = r.choice("abcdefgh")
            t = "".join(t)
        if i % 5 == 0:
            t += "".join(chr(r.randrange(0x4E00, 0x4E00 + 2000)) for _ in range(r.randrange(1, 60)))
        out.append(t)
    return [*out, "", None, "ab", "AB ", "abc", "abcd", "abc" * 40, "abc" * 41, out[0] + " ", out[7].upper()]


def wanted(texts, threshold):
    first = {}
    for i, t in texts:
        first.setdefault((t or "").lower().strip(), i)
    sets = {i: {t[k : k + 3] for k in range(len(t) - 2)} for t, i in first.items()}
    out = {}
    for i in sorted(sets):
        for j in sorted(sets):
            if j >= i:
                break
            k = len(sets[i] & sets[j])
            if k and k / (len(sets[i]) + len(sets[j]) - k) >= threshold:
                out[i] = (j, k / (len(sets[i]) + len(sets[j]) - k))
                break
    return out


@pytest.mark.parametrize(("threshold", "shares"), [(0.9, 32768), (0.9, 20), (0.6, 50), (1.0, 15)])
def test_earlier_equals_all_pairs(spark, monkeypatch, threshold, shares):
    """Also in many small shares, where a pair meets in one of them."""
    monkeypatch.setattr(gram_sets, "SETS", shares)
    rows = list(enumerate(alike(150)))
    got = {r["doc_id"]: (r["match_id"], r["similarity"]) for r in dedup.verified(spark.createDataFrame(rows, DOCS).repartition(4), threshold).collect()}
    assert got == wanted(rows, threshold) and len(got) > (1 if threshold == 1 else 20)


def test_no_pairs_between_steps(spark):
    """Of documents that nearly all are candidates of each other no table has more rows than there are documents."""
    rows = list(enumerate(alike(200, seed=4, least=1800, most=2000)))
    top = Path(scratch.folder(spark).removeprefix("file:"))
    before = set(top.rglob("*.parquet"))
    assert len(dedup.verified(spark.createDataFrame(rows, DOCS), 0.9).collect()) == len(wanted(rows, 0.9))
    tables = {}
    for p in set(top.rglob("part-*.parquet")) - before:
        tables[p.parent] = tables.get(p.parent, 0) + pq.read_metadata(p).num_rows
    assert tables and max(tables.values()) <= len(rows)


@pytest.mark.parametrize("sample", [0, 1, 40])
def test_the_sample_decides_nothing(monkeypatch, sample):
    """Any trigrams, directions and portions give the pairs of the sets."""
    for name, n in (("ROWS", 20), ("PAIRS", 30), ("NUMBERS", 500)):
        monkeypatch.setattr(gram_sets, name, n)
    rows = [(i, t) for i, t in enumerate(alike(90)) if t and len(t) > 2]
    want = wanted(rows, 0.85)
    words, mean, directions = gram_sets.fit([t.lower() for _, t in rows[:sample]])
    seen, table = set(), []
    for i, t in rows:
        codes = gram_sets.grams(t.lower().strip())
        bits, rest = gram_sets.split(codes, words)
        if t.lower().strip() not in seen:
            table.append((i, len(codes), gram_sets.zlib.compress(bits.tobytes() + rest.tobytes()), 0, True))
        seen.add(t.lower().strip())
    t = pa.table(dict(zip(("doc_id", "n", "packed", "share", "home"), map(list, zip(*table, strict=True)), strict=True)))
    out = gram_sets.Block(t, mean, directions, 0.85).found(0, 0).to_pylist()
    assert {r["doc_id"]: (r["match_id"], r["similarity"]) for r in out} == want and len(want) > 10
    assert np.allclose(directions.T @ directions, np.eye(directions.shape[1]), atol=1e-4)


def test_no_documents(spark):
    assert dedup.verified(spark.createDataFrame([], DOCS)).collect() == []
    assert dedup.verified(spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (None, "abcdef"), (4, "abcdef")], DOCS)).collect() == []
