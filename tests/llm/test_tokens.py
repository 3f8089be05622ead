"""Token operators against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe_codec, bytebpe, packing, token_counts
from quillspark.llm.common import tune

SF = "/root/testdata/sf0.001"
PIECES = list("abcdeÀéßİΣσς'sstreve mlld  \n\t\r\x85\xa0　\x1c1234½²!?.,<|>ab中文にほんǅ́é☃😀")


def odd_texts(n=400):
    r = random.Random(5)
    made = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [*made, "<|endoftext|>a <|startoftext|>b'll", "it's 'tis ''s !'s", "a" * 3000, "ab " * 3000, "x" + "ab" * 9000, "\n" * 300 + "a" + " " * 300]


@pytest.fixture(scope="module")
def frame(spark):
    tune(spark)
    texts = [*odd_texts(), "", None, "repeated", "repeated"]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, n_tokens string")


def library(name):
    t = Tokenizer.from_file(bytebpe.default_path(name))
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)], t


def test_counts(spark, frame):
    encode, _ = library("word_bpe_49k.json")
    rows = frame.orderBy("doc_id", "text").collect()
    got = token_counts.token_counts(frame, limit=10).join(frame.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").collect()
    want = dict(zip([r["text"] for r in rows], map(len, encode([r["text"] for r in rows])), strict=True))
    assert len(got) == frame.where("doc_id is not null").count()
    for r in got:
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want[r["t"]], len((r["t"] or "").encode()), want[r["t"]] > 10)
    assert token_counts.token_counts(frame).where("doc_id is null").count() == 1
    assert token_counts.token_counts(frame.limit(0)).count() == 0


def test_prefix_scan():
    s = token_counts.PieceScanner()
    for t in odd_texts(50):
        if t:
            s.CHUNK = 64
            whole = s.starts(t)
            s.CHUNK = 1
            assert np.array_equal(whole, s.starts(t))


@pytest.mark.parametrize("leaf", [16, 40, 16_384])
def test_tree_concatenation(leaf):
    encode, t = library("byte_bpe_50k.json")
    b = bytebpe.ByteBpe(bytebpe.default_path("byte_bpe_50k.json"))
    b.LEAF = leaf
    texts = odd_texts()
    for x, ids in zip(texts, encode(texts), strict=True):
        assert b.encode(x) == ids
        assert b.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_codec(spark, frame):
    encode, _ = library("byte_bpe_50k.json")
    got = bpe_codec.encode_decode(frame, digests=True).orderBy("doc_id").collect()
    by_id = {r["doc_id"]: r["text"] for r in frame.collect()}
    for r in got:
        ids = encode([by_id[r["doc_id"]]])[0]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((by_id[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe_codec.encode_decode(frame.limit(0)).count() == 0


def test_packing(spark, frame):
    encode, _ = library("byte_bpe_50k.json")
    rows = packing.pack(frame, row_len=64, block_tokens=5000).collect()
    got: dict = {}
    for r in rows:
        ids, pos, ends = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == 64 and ends[-1] == r["n_tokens"] <= 64
        for k, (d, o) in enumerate(zip(r["doc_ids"], r["doc_offsets"], strict=True)):
            seg = slice(ends[k], ends[k + 1])
            assert pos[seg].tolist() == list(range(ends[k + 1] - ends[k]))
            got.setdefault(d, {}).setdefault(o, []).append(ids[seg].tolist())
    texts = frame.collect()
    for r, ids in zip(texts, encode([r["text"] for r in texts]), strict=True):
        copies = sum(x["doc_id"] == r["doc_id"] for x in texts)
        assert all(len(v) == copies for v in got[r["doc_id"]].values())
        assert [x for o in sorted(got[r["doc_id"]]) for x in got[r["doc_id"]][o][0]] == [*ids, 50256]
    assert packing.pack(frame.limit(0)).count() == 0


def test_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(50):
        sizes = [r.randint(1, 50) for _ in range(80)]
        rows = packing.best_fit_decreasing(sizes, 50)
        assert sorted(i for g in rows for i in g) == list(range(80)) and all(sum(sizes[i] for i in g) <= 50 for g in rows)
        free: list[int] = []
        for i in sorted(range(80), key=lambda i: -sizes[i]):
            fit = [f for f in free if f >= sizes[i]]
            if fit:
                free[free.index(min(fit))] -= sizes[i]
            else:
                free.append(50 - sizes[i])
        assert len(free) == len(rows)


def test_long_repetitive_pieces():
    """Pieces without a space that repeat themselves, as the library encodes them; work grows with the length."""
    import time

    encode, _ = library("byte_bpe_50k.json")
    bpe = bytebpe.load(bytebpe.default_path("byte_bpe_50k.json"))
    r = random.Random(6)
    texts = ["a" * n for n in (63, 64, 65, 129, 5000, 30_000)] + ["=" * 20_000, "7" * 9000, "ab" * 9000, "abc" * 7000, "-=" * 5000, "é" * 4000, "日" * 3000]
    texts += [("xyz" * r.randrange(1, 300) + "q" * r.randrange(1, 500)) * r.randrange(1, 5) for _ in range(30)]
    texts += ["".join(r.choice(["a" * r.randrange(1, 900), "  ", "\n", "ha" * r.randrange(1, 400), "don't ", "===" * 90, "<|endoftext|>"]) for _ in range(6)) for _ in range(60)]
    assert [bpe.encode(t) for t in texts] == encode(texts)
    began = time.perf_counter()
    bpe.encode("a" * 25_000)
    once = time.perf_counter() - began
    began = time.perf_counter()
    assert len(bpe.encode("a" * 250_000)) < 250_000
    assert time.perf_counter() - began < 40 * once + 2
