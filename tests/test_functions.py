"""Functions against their definitions."""

import random
import re
import time
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import chunking, filters, fuzzy, snippets, text
from quillspark.operators import providers


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=12), st.text("abcd", max_size=25))
def test_ratios(a, b):
    assert fuzzy.lcs(a, b) == dp(a, b)
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return
    m, n = len(s), len(t)
    windows = [t[:k] for k in range(1, m)] + [t[i : i + m] for i in range(n - m + 1)] + [t[k:] for k in range(n - m + 1, n)]
    assert abs(fuzzy.partial_ratio(a, b) - max(200 * dp(s, w) / (m + len(w)) for w in windows)) < 1e-9


def test_long_query_ratio():
    r = random.Random(1)
    s, t = "".join(r.choices("abcd", k=80)), "".join(r.choices("abcd", k=200))
    m, n = len(s), len(t)
    windows = [t[:k] for k in range(1, m)] + [t[i : i + m] for i in range(n - m + 1)] + [t[k:] for k in range(n - m + 1, n)]
    assert abs(fuzzy.partial_ratio(s, t) - max(200 * dp(s, w) / (m + len(w)) for w in windows)) < 1e-9


PARSED = [
    ("a:1", filters.Leaf("a", "=", 1)),
    ("a:>=1.5", filters.Leaf("a", ">=", 1.5)),
    ("tags:[x, y]", filters.Leaf("tags", "ANY", ["x", "y"])),
    ('a:"x AND y"', filters.Leaf("a", "=", "x AND y")),
    ("NOT a:true", filters.Not(filters.Leaf("a", "=", True))),
]


@pytest.mark.parametrize(("expr", "tree"), PARSED)
def test_filter_parser(expr, tree):
    assert filters.parse(expr) == tree


@pytest.mark.parametrize("bad", ["", "a", "NOT NOT a:1", "(a:1", "a:"])
def test_filter_parser_rejects(bad):
    with pytest.raises(ValueError):
        filters.parse(bad)


def test_filters(spark):
    docs = ['{"c":"tech","y":2024,"t":["a","b"],"b":true}', '{"c":"Bio","y":"2024"}', "{}", None, '{"y":2020.5}']
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, metadata string")
    for expr, want in [("c:tech AND y:>2023", [0]), ("y:>2000", [0, 4]), ("y:!=2024", [1, 4]), ("NOT y:2024", [1, 2, 3, 4]), ("c:~TEC", [0]), ("t:[b,z]", [0]), ("b:true", [0]), ("(c:tech AND y:1) OR c:Bio", [1])]:
        assert sorted(r["doc_id"] for r in filters.apply_filter(df, expr).collect()) == want, expr


def test_schema(spark):
    docs = ['{"d":"2024-01-02T03:04:05Z","n":1}', '{"d":"x"}', '{"n":true}', '{"n":"1"}', "{}"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, metadata string")
    assert [r[0] for r in df.select(filters.valid(F.col("metadata"), {"d": "DATE", "n": "NUMBER"})).collect()] == [True, False, True, False, True]


def test_text_edges(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, " Ab \n c "), (3, "Привет мир"), (4, "123"), (5, "naïve Naïve")], "id long, t string")
    got = df.select("id", text.tokens(F.col("t")).alias("k"), text.normalise(F.col("t")).alias("n"), text.script(F.col("t")).alias("s"), text.highlight(F.col("t"), F.lit("Ab naïve")).alias("h")).orderBy("id").collect()
    assert [r["k"] for r in got] == [[], [], ["ab", "c"], [], ["123"], ["na", "ve", "na", "ve"]]
    assert [r["n"] for r in got] == ["", "", "Ab c", "Привет мир", "123", "naïve Naïve"]
    assert [r["s"] for r in got] == [None, None, "Latin", "Cyrillic", None, "Latin"]
    assert got[2]["h"] == " <mark>Ab</mark> \n c "


def test_snippets():
    body = "x " * 100 + "needle " + "y " * 100
    one = snippets.snippets_of(body, "needle")
    assert len(one) == 1 and "<mark>needle</mark>" in one[0] and one[0].startswith("...") and one[0].endswith("...")
    assert snippets.snippets_of("short", "zzz") == ["short"]
    assert len(snippets.snippets_of("a a a a a a", "a", dedupe=True)) == 1


def test_chunkers(spark):
    long = ". ".join(f"Sentence number {i}" for i in range(120)) + "."
    body = "tiny\n\n" + "p" * 80 + "\n \n" + long + "\n\nend"
    df = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "One. Two! Three? Four.")], "doc_id long, text string")
    assert [r["content"] for r in chunking.sentence_chunks(df).where("doc_id = 4").orderBy("chunk_id").collect()] == ["One. Two! Three?", "Three? Four."]
    parts = [r["content"] for r in chunking.paragraph_chunks(df).where("doc_id = 1").orderBy("chunk_id").collect()]
    assert parts[0] == "tiny\n\n" + "p" * 80 and parts[-1].endswith("\n\nend")
    for bad in ((3, 3), (0, 0), (2, -1)):
        with pytest.raises(ValueError):
            chunking.sentence_chunks(df, *bad)
        with pytest.raises(ValueError):
            chunking.sliding_chunks(df, *bad)
    with pytest.raises(ValueError):
        chunking.chunk(df, "nope")
    n = len("x" * 897)
    windows = chunking.sliding_chunks(spark.createDataFrame([(1, "x" * n)], "doc_id long, text string")).orderBy("chunk_id").collect()
    assert [(r["start_char"], r["end_char"]) for r in windows] == [(0, 512), (384, 896), (768, 897)]


def test_white_space(spark):
    """As the regular expressions of all white space have it, also in a text with a long run inside, which took its square before."""
    r = random.Random(2)
    chars = text.SPACES + "ab\x1c\x84᠎​⁠﻿Z"
    rows = [(None,), ("",), ("a" + " " * 300_000 + "b",)] + [("".join(r.choices(chars, k=r.randrange(14))),) for _ in range(3000)]
    rows += [(f"{chr(i)}a{chr(i)}{chr(i)}b{chr(i)}",) for i in range(0x3100)]
    d, c = spark.createDataFrame(rows, "t string"), F.col("t")
    short = d.where("length(t) < 99 or t is null")
    edges = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    want = edges(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    words = F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    same = edges(c).eqNullSafe(text.strip(c)) & (want == text.normalise(c)) & (words == text.word_count(c)) & (words == text.word_count(text.normalise(c), normal=True))
    assert short.where(~same).count() == 0
    began = time.monotonic()
    assert d.where("length(t) > 99").select(F.length(text.strip(c)), text.normalise(c), text.word_count(c)).collect() == [(300_002, "a b", 2)]
    assert time.monotonic() - began < 20


def test_hashed_tokens():
    """Equal to one CRC a token."""
    r = random.Random(3)
    for _ in range(100):
        texts = [None if r.random() < 0.1 else "".join(r.choices("abXYZ_09 \n.éİK　", k=r.choice([0, 1, 80]))) + r.choice(["", "a" * 64, "b" * 65, "c" * 500]) for _ in range(r.randrange(5))]
        want = [(crc32(w.encode()), i) for i, t in enumerate(texts) for w in re.findall("[a-z0-9_]+", (t or "").lower())]
        h, row = providers.hashed_tokens(texts)
        assert list(zip(h.tolist(), row.tolist(), strict=True)) == want
