"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, compact_windows, cross_parsing, decontamination, hard_negatives, minhash, multi_index, packing, pitman_yor, prefix_trie, suffix_dedup, token_counts, toxicity
from .common import documents, held_out


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by the model of the texts not held out."""
    return pitman_yor.score_documents(documents(spark, sf_dir))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents on two-word shingles."""
    return minhash.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as byte-level BPE ids, packed into rows of 2048."""
    return packing.pack(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text by the compiled word tokenizer."""
    return token_counts.token_counts(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its 400-byte strings that occur elsewhere."""
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), length=400)


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label."""
    return multi_index.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.93)


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that resemble one of an earlier document."""
    return compact_windows.passage_report(documents(spark, sf_dir))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; digests of both."""
    return bpe_codec.encode_decode(documents(spark, sf_dir), digests=True)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text by its nearest labelled examples."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "neighbours", "evidence")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document, by greedy string tiling."""
    return decontamination.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector among all, with every 7th label moved on by one."""
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(x.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the labelled ones not held out."""
    docs = documents(spark, sf_dir).withColumn("held_out", held_out("doc_id", 5, 0))
    model = cross_parsing.fit(docs.where("not held_out"))
    return cross_parsing.identify(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "n_phrases", "bits_per_byte")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, most of which start like another one of their five."""
    turns = prefix_trie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.trie(*prefix_trie.rebuilt(turns, family=5, heads=9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pitman_yor, op2_minhash, op3_packing, op4_token_counts, op5_suffix_dedup, op6_multi_index, op7_compact_windows, op8_bpe_codec, op9_toxicity, op10_decontamination, op11_hard_negatives, op12_cross_parsing, op13_prefix_trie)}


_REACH = "r AS (SELECT id AS a, id AS b FROM ids UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)"

#: Sets of two-word shingles, all pairs that share one, and reachability.
OP2_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
o AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (m.n + q.n - k)),
l AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o), ids AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(r.b) AS component_id, min(r.b) = doc_id AS kept FROM n JOIN r ON r.a = doc_id GROUP BY doc_id, n"""

OP6_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
ids AS (SELECT vec_id AS id FROM embeddings), {_REACH}, c AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(any_value(k), 0) AS BIGINT) AS n_links, min(r.b) AS component_id, min(r.b) = id AS kept FROM ids JOIN r ON r.a = id LEFT JOIN c ON c.a = id GROUP BY id"""


#: Every anchor against every row.
OP11_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 3"""

#: Conversations as lists of turns, rebuilt and grouped by each of their prefixes; crc32 is worked out bit by bit.
OP13_SQL = """WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda r, b: list_reduce([xor(r, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))), CAST(4294967295 AS BIGINT))) % 9 AS h FROM t),
r AS (SELECT h.conv_id AS c, CASE WHEN h.conv_id % 5 = 0 THEN h.t ELSE list_concat(coalesce(b.t, [])[:h.h], h.t[h.h + 1:]) END AS t FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT c, unnest(range(0, len(t) + 1)) AS depth, t FROM r),
k AS (SELECT c, depth, len(t) = depth AS ends, t[:depth] AS p, octet_length(encode(CASE WHEN depth = 0 THEN '' ELSE t[depth].text END)) AS b FROM m),
n AS (SELECT depth, p, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM k GROUP BY depth, p),
u AS (SELECT n.*, q.conv_id AS parent FROM n LEFT JOIN n q ON q.depth = n.depth - 1 AND q.p = n.p[:n.depth - 1]),
l AS (SELECT u.depth, u.conv_id, NOT EXISTS (SELECT 1 FROM u c WHERE c.depth = u.depth + 1 AND c.parent = u.conv_id) AS leaf, (u.n_convs - 1) * u.b AS saved, u.p FROM u)
SELECT u.conv_id, u.depth, u.parent AS parent_conv_id, u.n_convs, (SELECT count(*) FROM u c WHERE c.depth = u.depth + 1 AND c.parent = u.conv_id) AS n_children, x.n_leaves, x.saved_tokens, u.ends_sha256
FROM u JOIN (SELECT a.depth, a.p, CAST(count(*) FILTER (WHERE l.leaf) AS BIGINT) AS n_leaves, CAST(sum(l.saved) AS BIGINT) AS saved_tokens FROM n a JOIN l ON l.depth >= a.depth AND l.p[:a.depth] = a.p GROUP BY a.depth, a.p) x ON x.depth = u.depth AND x.p = u.p"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express in reasonable time; the tests hold the others against brute force."""
    return {"op2_minhash": OP2_SQL, "op6_multi_index": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op13_prefix_trie": OP13_SQL}
