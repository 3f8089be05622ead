"""BPE encoding and decoding of whole texts by tree concatenation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytebpe
from .common import text_batches

SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


FULL_SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the text decoded from them; edge cases as in encode_decode."""
    path = tokenizer or bytebpe.default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bytebpe.load(path)
        for keys, texts in text_batches(batches, 1 << 20):
            ids = [bpe.encode(t) for t in texts]
            a = [hashlib.sha256(bpe.digits(e).encode()).hexdigest() for e in ids]
            b = [hashlib.sha256(bpe.decode(e).encode()).hexdigest() for e in ids]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, FULL_SCHEMA)


def encode_decode(docs: DataFrame, tokenizer: str | None = None, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each text and the text decoded from them; with digests, their SHA-256 instead.

    Null text counts as empty (0 tokens). Rows are mapped one by one: repeated rows stay, a null id stays null, an empty table gives an empty result and other columns are not looked at.
    No shuffle; memory is that of a few megabytes of text.
    """
    path = tokenizer or bytebpe.default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bytebpe.load(path)
        for keys, texts in text_batches(batches):
            encoded = [bpe.encode(t) for t in texts]
            n = pa.array(list(map(len, encoded)), pa.int64())
            if digests:
                a = pa.array([hashlib.sha256(bpe.digits(e).encode()).hexdigest() for e in encoded])
                b = pa.array([hashlib.sha256(bpe.decode(e).encode()).hexdigest() for e in encoded])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), n, a, b], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), n, pa.array(encoded, pa.list_(pa.int32())), pa.array([bpe.decode(e) for e in encoded], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, DIGEST_SCHEMA if digests else SCHEMA)
