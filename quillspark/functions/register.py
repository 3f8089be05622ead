"""Names for SQL: scalar functions, and chunkers as table functions for LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .chunking import paragraphs_of
from .fuzzy import pair_partial, pair_ratio

#: Functions whose bodies are SQL: the optimizer sees through them.
SCALARS = {
    "text_tokens(t STRING) RETURNS ARRAY<STRING>": "regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9_]+', 0)",
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + coalesce(x, 0D))",
    "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN vector_dot(a, a) * vector_dot(b, b) = 0 THEN 0D ELSE vector_dot(a, b) / (sqrt(vector_dot(a, a)) * sqrt(vector_dot(b, b))) END",
    "token_overlap(q STRING, t STRING) RETURNS DOUBLE": "CASE WHEN size(text_tokens(q)) = 0 THEN 0D ELSE size(array_intersect(text_tokens(q), text_tokens(t))) / size(array_distinct(text_tokens(q))) END",
}
_SENTENCES = r"filter(split(regexp_replace(coalesce(t, ''), '(?U)^\\s+|\\s+$', ''), '(?U)(?<=[.!?])\\s+'), s -> s RLIKE '(?U)\\S')"
#: Table functions of one text: SQL, too. Each is a generator alone, which LATERAL makes rows of where the text lies; a subquery would be joined to its texts by the texts themselves.
TABLES = {
    "chunk_sentence(t STRING, most INT DEFAULT 3, overlap INT DEFAULT 1) RETURNS TABLE (chunk_id INT, content STRING, sentences INT)": f"SELECT * FROM inline(flatten(transform(array({_SENTENCES}), s -> transform(IF(size(s) > 0, sequence(0, size(s) - 1, most - overlap), array()), (i, k) -> named_struct('chunk_id', k, 'content', array_join(slice(s, i + 1, most), ' '), 'sentences', least(most, size(s) - i))))))",
}


class _Paragraphs:
    def eval(self, text: str, least: int, most: int) -> Iterator[tuple[int, str, int]]:
        for k, c in enumerate(paragraphs_of(text or "", least, most)):
            yield k, c["content"], c["start"]


def register(spark: SparkSession) -> None:
    """text_tokens, vector_dot, vector_cosine, token_overlap, fuzzy_ratio, fuzzy_partial, chunk_sentence(text[, sentences, overlap]) and chunk_paragraph(text, least, most) for the session's SQL."""
    for head, body in {**SCALARS, **TABLES}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("fuzzy_ratio", pair_ratio())
    spark.udf.register("fuzzy_partial", pair_partial())
    spark.udtf.register("chunk_paragraph", udtf(_Paragraphs, returnType="chunk_id int, content string, start_char int"))
