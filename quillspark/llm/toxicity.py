"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine, found through a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_batches
from .words import hash_words

SCHEMA = "doc_id long, score double, neighbours array<long>, similarities array<double>, evidence array<string>"
#: Scores from here on count as toxic.
THRESHOLD = 0.3
#: Characters of the texts that drop_toxic scores at once: a megabyte takes some hundred MB more, and a job's later stages run beside what a worker has grown to.
PORTION = 1 << 17


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all ranges [start, end) one after the other, number of the range of each)."""
    n = end - start
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + start[own], own


def term_counts(texts: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(text number, term, occurrences, first word of it) of the distinct words of each text, sorted by text and term, and the words' (starts, ends, bytes).

    Terms are places in known (sorted hashes; others are left out), or the hashes themselves.
    """
    h, first, starts, ends, buf = hash_words(texts, letters_only=True)
    own = np.repeat(np.arange(len(texts)), np.diff(first))
    word = np.arange(len(h))
    if known is not None:
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        ok = known[at] == h if len(known) else np.zeros(len(h), dtype=bool)
        h, own, word = at[ok], own[ok], word[ok]
    order = np.lexsort((word, h, own))
    h, own, word = h[order], own[order], word[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])))) if len(h) else np.zeros(0, dtype=np.int64)
    return own[new], h[new], np.diff(np.concatenate((new, [len(h)]))), word[new], (starts, ends, buf)


@dataclass
class Model:
    """Inverted index over blocks of examples: for each term and block with it the greatest weight, and the weights of the block's examples."""

    known: np.ndarray  # hashes of the terms, sorted
    gain: np.ndarray  # inverse document frequency times relevance of a term
    row_start: np.ndarray  # by term: its rows, one for each block that holds it
    row_block: np.ndarray
    row_max: np.ndarray
    row_start_posting: np.ndarray  # by row: its postings
    example: np.ndarray  # of a posting
    weight: np.ndarray
    labels: np.ndarray
    votes: np.ndarray  # of the examples, undoing the sampling by class
    ids: np.ndarray
    blocks: int
    block: int
    k: int
    prior: float
    _common: tuple[np.ndarray, np.ndarray] | None = None

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """(place by term or -1, weights of all examples) of the terms that over a sixteenth of the examples have, laid out when first asked for."""
        if self._common is None:
            width = self.blocks * self.block
            n = self.row_start_posting[self.row_start[1:]] - self.row_start_posting[self.row_start[:-1]] if len(self.known) else np.zeros(0)
            terms = np.flatnonzero(n > width / 16)
            place = np.full(len(self.known), -1, dtype=np.int64)
            place[terms] = np.arange(len(terms))
            at, own = ranges(self.row_start_posting[self.row_start[terms]], self.row_start_posting[self.row_start[terms + 1]])
            out = np.zeros((len(terms), width))
            out[own, self.example[at]] = self.weight[at]
            self._common = place, out
        return self._common

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(examples, cosines) of the k nearest of each text, best first, -1 where fewer have a cosine over 0; equal cosines in the examples' order; and the texts' terms.

        Blocks are read by falling upper bound, the first few, then more, until no bound reaches the k-th best cosine; so the result is exact.
        """
        d, t, tf, word, where = term_counts(texts, self.known)
        v = (1 + np.log(tf)) * self.gain[t]
        norm = np.sqrt(np.bincount(d, weights=v * v, minlength=len(texts)))
        v = v / np.where(norm > 0, norm, 1)[d]
        first = np.searchsorted(d, np.arange(len(texts) + 1))
        # The words of many examples are added up first, in one product; bounds are for the others.
        place, laid_out = self.common()
        often = place[t] >= 0
        here = np.zeros((len(texts), len(laid_out)))
        here[d[often], place[t[often]]] = v[often]
        width = self.blocks * self.block
        cosine = here @ laid_out
        bound = cosine.reshape(len(texts), self.blocks, self.block).max(axis=2)
        x = np.flatnonzero(~often)
        row, own = ranges(self.row_start[t[x]], self.row_start[t[x] + 1])
        own = x[own]
        cell = d[own] * self.blocks + self.row_block[row]
        bound += np.bincount(cell, weights=v[own] * self.row_max[row], minlength=bound.size).reshape(bound.shape)
        order = np.argsort(-bound, axis=1, kind="stable")
        # Examples of blocks not read have no part in the result: their cosines can't reach the k-th best.
        cosine, seen = cosine.reshape(-1), np.zeros(len(texts) * self.blocks, dtype=bool)
        least = np.zeros(len(texts))  # the k-th best so far
        lo, step = 0, 4
        while lo < self.blocks:
            turn = order[:, lo : lo + step]
            ub = np.take_along_axis(bound, turn, axis=1)
            text, place = np.nonzero((ub > 0) & (ub >= least[:, None] - 1e-9))
            if not len(text):
                break
            visited = np.zeros(len(texts) * self.blocks, dtype=bool)
            visited[text * self.blocks + turn[text, place]] = True
            seen |= visited
            x = np.flatnonzero(visited[cell])
            r, term = row[x], own[x]
            posting, o = ranges(self.row_start_posting[r], self.row_start_posting[r + 1])
            term = term[o]
            cosine += np.bincount(d[term] * width + self.example[posting], weights=v[term] * self.weight[posting], minlength=len(cosine))
            touched = np.unique(text)
            if width > self.k:
                known = np.where(np.repeat(seen, self.block).reshape(-1, width)[touched], cosine.reshape(-1, width)[touched], 0)
                least[touched] = np.partition(known, width - self.k, axis=1)[:, width - self.k]
            lo, step = lo + step, step * 4
        best, who = np.zeros((len(texts), self.k)), np.full((len(texts), self.k), -1, dtype=np.int64)
        cosine = np.where(np.repeat(seen, self.block), cosine, 0).reshape(-1, width)
        for i in range(len(texts)):
            at = np.flatnonzero(cosine[i] >= max(least[i] - 1e-9, 1e-12))
            s = np.round(cosine[i, at], 9)
            top = np.lexsort((at, -s))[: self.k]
            who[i, : len(top)], best[i, : len(top)] = at[top], s[top]
        return who, best, (d, t, v, word, first, where)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """(score of each text, its examples, their cosines, terms): votes weighted by nearness, drawn to the prior where nothing is near."""
        at, s, terms = self.nearest(texts)
        vote = np.where(at >= 0, self.votes[at] * s / (1.25 - np.minimum(s, 1.0)), 0)
        least = 0.05 * (self.votes[: len(self.ids)].min() if len(self.ids) else 1.0)
        score = ((vote * self.labels[at]).sum(axis=1) + least * self.prior) / (vote.sum(axis=1) + least)
        return np.clip(score, 0.0, 1.0), at, s, terms

    def evidence(self, i: int, at: np.ndarray, terms: tuple) -> list[str]:
        """The five weightiest words of text i that one of its three nearest examples has too."""
        _, t, v, word, first, (starts, ends, buf) = terms
        x = np.arange(first[i], first[i + 1])
        near = [e for e in at[i, :3].tolist() if e >= 0]
        row, own = ranges(self.row_start[t[x]], self.row_start[t[x] + 1])
        keep = np.isin(self.row_block[row], [e // self.block for e in near])
        row, own = row[keep], own[keep]
        posting, o = ranges(self.row_start_posting[row], self.row_start_posting[row + 1])
        shared = np.zeros(len(x), dtype=bool)
        shared[own[o[np.isin(self.example[posting], near)]]] = True
        x = x[shared]
        return [buf[starts[w] : ends[w]].tobytes().decode("utf-8", "replace") for w in word[x[np.argsort(-v[x], kind="stable")[:5]]].tolist()]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, k: int = 15, block: int = 64) -> Model:
    """Learn from at most per_class labelled documents of each class (the least hashes of the id), outside the held-out rows.

    The sample is the documented bound of what reaches the driver and goes to the executors: at most 2 * per_class sparse vectors. Every word of theirs is a term: weight (1 + log tf) * idf, scaled by the chi-square of the word and the label, so words that say nothing of the label hardly count. Document frequencies are those of all documents, class counts those of all labelled rows.
    Of labels, rows with a null id or a label other than 0 and 1 are left out; an id with both labels is toxic.
    """
    spark = docs.sparkSession
    lab = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4)).groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    order = F.xxhash64(F.col("doc_id"))
    picked = lab.where("y = 1").orderBy(order, "doc_id").limit(per_class).unionByName(lab.where("y = 0").orderBy(order, "doc_id").limit(per_class))
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # Of repeated rows of one id, one is an example.
    rows = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, y, x in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                _, h, tf, _, _ = term_counts([x])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([h.astype("<u8").tobytes()], pa.binary()), pa.array([tf.astype("<i4").tobytes()], pa.binary())], ["doc_id", "y", "words", "tf"])

    sample = sorted(rows.mapInArrow(split, "doc_id long, y int, words binary, tf binary").collect(), key=lambda r: r["doc_id"])
    words = [np.frombuffer(r["words"], dtype="<u8") for r in sample]
    y = np.array([r["y"] for r in sample], dtype=np.int64)
    m1, m0 = int(y.sum()), int((1 - y).sum())
    by_class = {1: n1 / max(1, m1), 0: n0 / max(1, m0)}
    known, term = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *words]), return_inverse=True)
    own = np.repeat(np.arange(len(sample)), [len(w) for w in words]).astype(np.int64)
    df, n_docs = _document_frequencies(text, known)
    a, n = np.bincount(term, weights=y[own], minlength=len(known)), max(1, m1 + m0)
    both = np.bincount(term, minlength=len(known)).astype(float)
    chi2 = n * (a * (m0 - (both - a)) - (both - a) * (m1 - a)) ** 2 / np.maximum(both * (n - both) * m1 * m0, 1.0)
    gain = (np.log((1 + n_docs) / (1 + df)) + 1) * chi2
    tf = np.frombuffer(b"".join(r["tf"] for r in sample), dtype="<i4")
    weight = (1 + np.log(np.maximum(tf, 1))) * gain[term]
    norm = np.sqrt(np.bincount(own, weights=weight**2, minlength=len(sample)))
    weight = weight / np.where(norm > 0, norm, 1)[own]
    # Examples with the same label and weightiest word stand together, so that block maxima are tight.
    heavy = np.zeros(len(sample), dtype=np.int64)
    by_weight = np.lexsort((weight, own))
    last = np.flatnonzero(np.diff(own[by_weight], append=-1)) if len(own) else np.zeros(0, dtype=np.int64)
    heavy[own[by_weight[last]]] = term[by_weight[last]]
    stand = np.lexsort((np.arange(len(sample)), heavy, y))
    place = np.empty(len(sample), dtype=np.int64)
    place[stand] = np.arange(len(sample))
    blocks = max(1, -(-len(sample) // block))
    keep = weight > 0
    term, weight, at = term[keep], weight[keep], place[own[keep]]
    order_ = np.lexsort((at, term))
    term, weight, at = term[order_], weight[order_].astype(np.float32), at[order_]
    row = np.concatenate(([True], (term[1:] != term[:-1]) | (at[1:] // block != at[:-1] // block)))[: len(term)]
    start = np.flatnonzero(row)
    width = blocks * block
    labels_, votes = np.zeros(width), np.full(width, 1e-9)
    labels_[: len(sample)] = y[stand]
    votes[: len(sample)] = np.where(y[stand] == 1, by_class[1], by_class[0])
    bare = norm == 0
    bare1, bare0 = float((bare & (y == 1)).sum()), float((bare & (y == 0)).sum())
    prior = (bare1 * by_class[1] + 0.5 * n1 / max(1, n1 + n0)) / (bare1 * by_class[1] + bare0 * by_class[0] + 0.5)
    return Model(
        known, gain, np.searchsorted(term[start], np.arange(len(known) + 1)), at[start] // block, np.nextafter(np.maximum.reduceat(weight, start), np.float32(2)) if len(start) else weight,
        np.concatenate((start, [len(term)])), at.astype(np.int32), weight, labels_, votes, np.array([sample[i]["doc_id"] for i in stand.tolist()], dtype=np.int64), blocks, block, k, float(prior) if n1 + n0 else 0.0,
    )


def _document_frequencies(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of docs (doc_id, text) each of the known words is, and the number of docs; partitions send one sum a word."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = shared.value, 0
        df = np.zeros(len(words), dtype=np.int64)
        for keys, texts in text_batches(batches, 1 << 20):
            df += np.bincount(term_counts(texts, words)[1], minlength=len(words))
            n += len(keys)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], ["term", "n"])

    rows = docs.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(known) + 1)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()  # the last place: -1, the number of docs
    return out[:-1], int(out[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score (0 to 1), nearest examples and shared words of each text.

    Null and empty texts, and texts without a known word, get the share of toxic ones among labelled texts of that kind. Words are lower-cased runs of ASCII letters, digits, underscores and all characters beyond ASCII, of any length. Repeated rows get the same score, equal cosines count by the examples' order, a null id stays null, an empty table gives an empty result; without labels the score is 0. Other columns, labels and ids are no inputs.
    The model goes to the executors as one broadcast of bounded size; nothing is shuffled. Texts are taken whole, in batches of about a megabyte; memory follows the longest text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for keys, texts in text_batches(batches, 1 << 20):
            value, at, s, terms = m.scores(texts)
            few = [x[x >= 0] for x in at[:, :3]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(value), pa.array([m.ids[x].tolist() for x in few], pa.list_(pa.int64())), pa.array([x[: len(e)].tolist() for x, e in zip(s, few, strict=True)], pa.list_(pa.float64())), pa.array([m.evidence(i, at, terms) for i in range(len(keys))], pa.list_(pa.string()))],
                ["doc_id", "score", "neighbours", "similarities", "evidence"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores under threshold.

    Rows are judged one by one by their text alone (null: empty): ids, repeated rows, order and other columns, whatever their names, don't matter; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lo = 0
            for keys, texts in text_batches(iter([pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), b.column(at)], ["i", "t"])]), PORTION):
                yield b.slice(lo, len(keys)).filter(pa.array(m.scores(texts)[0] < threshold))
                lo += len(keys)

    return docs.mapInArrow(run, docs.schema)
