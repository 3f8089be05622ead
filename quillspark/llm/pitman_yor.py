"""Language-model scores by a hierarchical Pitman-Yor bigram model.

Every word is a context restaurant whose dishes are the words that followed it; all share one parent restaurant of single words, whose base is uniform. Seats are sampled by blocked Gibbs sweeps, each from the state the one before left: given the tables of each context and the parent's predictive probabilities, all customers of one dish in one restaurant are seated anew, one after the other; the new tables are the parent's customers. Predictive probabilities are averaged over the samples kept.

Text stays in blocks of bounded size. A block sends its distinct words and word pairs, as sorted hashes, to buckets, and gets the totals back in the same order; so what is gathered grows with the corpus, no table of all words is in one place, and a word or pair with any share of the rows is one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, collected, discard, held_out, shuffle_width, stored
from .words import hash_words, mix

#: Characters of text in a block, and blocks whose entries one bucket holds.
BLOCK_CHARS, BLOCKS_A_BUCKET = 4 << 20, 8
END = np.uint64(0x5BD1E995C6A4A793)
#: Strength of the restaurants, samples kept, sweeps before them.
THETA, SAMPLES, BURN_IN = 1.0, 2, 1


def squeeze(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")


def expand(b: bytes, dtype: str) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T.tobytes(), dtype=dtype)


def squeeze_keys(k: np.ndarray) -> bytes:
    """Sorted keys as compressed differences."""
    return squeeze(np.diff(k, prepend=np.uint64(0)))


def expand_keys(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, "<u8"), dtype=np.uint64)


BLOCKS = "block long, ids array<long>, held binary, sizes binary, tokens binary, words binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents: ids, held-out flags, tokens a document (its end included), place of each token among the block's distinct word hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids: list = []
        held: list = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            h = np.concatenate([p[0] for p in parts])
            words, tok = np.unique(h, return_inverse=True)
            row = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([squeeze(np.array(held, dtype=np.uint8))]), pa.array([squeeze(np.concatenate([p[1] for p in parts]).astype("<i4"))]), pa.array([squeeze(tok.astype("<i4"))]), pa.array([squeeze_keys(words)])], [c.split()[0] for c in BLOCKS.split(", ")])
            number += 1
            for x in (ids, held, parts):
                x.clear()
            size = 0
            return row

        for b in batches:
            keys, texts, flags = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()], b.column(2).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= 1 << 20):
                    chars += len(texts[hi])
                    hi += 1
                h, first, *_ = hash_words(texts[lo:hi])
                n = np.diff(first)
                parts.append((np.insert(h, first[1:], END), n + 1))
                ids += keys[lo:hi]
                held += flags[lo:hi]
                size += chars
                lo = hi
                if size >= BLOCK_CHARS:
                    yield close()
        if ids:
            yield close()

    return docs.mapInArrow(run, BLOCKS)


class Block:
    """One block's tokens, contexts, distinct words and pairs."""

    def __init__(self, held: bytes, sizes: bytes, tokens: bytes, words: bytes):
        self.held, self.sizes = expand(held, "u1").astype(bool), expand(sizes, "<i4")
        self.tok, self.words = expand(tokens, "<i4"), expand_keys(words)
        self.train = np.repeat(~self.held, self.sizes)
        end = int(np.searchsorted(self.words, END))
        # The token before a text's first is the end of the text before.
        context = np.concatenate(([end], self.tok[:-1])).astype(np.int64)
        each = mix(self.words[context] * np.uint64(0xD6E8FEB86659FD93) + self.words[self.tok]) >> np.uint64(16)
        order = np.argsort(each)
        new = np.concatenate(([True], each[order[1:]] != each[order[:-1]]))
        at = order[new]
        self.keys = each[at]
        self.pair_of = np.empty(len(each), dtype=np.int64)
        self.pair_of[order] = np.cumsum(new) - 1
        self.u, self.w = context[at], self.tok[at].astype(np.int64)
        self.pair_train = np.bincount(self.pair_of[self.train], minlength=len(self.keys))
        self.word_train = np.bincount(self.tok[self.train], minlength=len(self.words))


def cuts(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Places at which sorted keys of `bits` bits pass from bucket to bucket; buckets is a power of two."""
    shift = bits - (buckets.bit_length() - 1)
    edges = [min(b << shift, (1 << 64) - 1) for b in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, dtype=np.uint64)), [len(keys)])).astype(np.int64)


MESSAGE = "kind int, bucket int, block long, keys binary, a binary, b binary"


def _messages(kind: int, block: int, keys: np.ndarray, bits: int, buckets: int, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    at = cuts(keys, buckets, bits)
    rows = [(kind, i, block, squeeze_keys(keys[x:y]), squeeze(a[x:y].astype("<i4")), squeeze(b[x:y].astype("<i4")) if b is not None else b"") for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if y > x]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in MESSAGE.split(", ")])


def _draw(seed: np.ndarray, step: int, sample: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from the seeds, so that every holder of a dish draws alike."""
    salt = (0x9E3779B97F4A7C15 * (2 * step + 1) + 0xC2B2AE3D27D4EB4F * sample) & ((1 << 64) - 1)
    return ((mix(seed + np.uint64(salt)) >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


#: Customers seated one by one in any case; those of a dish from which on likely new tables are drawn in runs, and the odds beyond which they count as likely.
ONE_BY_ONE, RUNS, FEW = 8, 64, 24


def tables(c: np.ndarray, alpha: np.ndarray, d: float, seed: np.ndarray, sample: int) -> np.ndarray:
    """Tables of dishes with c customers seated one after the other: a new table with odds alpha against customers - d * tables at the old ones.

    Later customers aren't visited one by one. Where new tables are rare, the number of customers up to the next one is drawn by inverting the product of their odds (a ratio of gamma functions, to a relative error under 1e-3); where they are likely and customers many, the new tables of a run of an eighth of the customers so far are a binomial draw by its normal limit.
    """
    t = (c > 0).astype(np.int64)
    at = np.flatnonzero(c > 1)
    some, weight, base, have = c[at], alpha[at].astype(np.float64), seed[at], t[at]
    for i in range(1, ONE_BY_ONE):
        if not len(at):
            return t
        have += _draw(base, i, sample) * (weight + (i - d * have)) < weight
        go = some > i + 1
        if not go.all():
            t[at[~go]] = have[~go]
            at, some, weight, base, have = at[go], some[go], weight[go], base[go], have[go]
    i, step = np.full(len(at), ONE_BY_ONE, dtype=np.int64), ONE_BY_ONE
    while len(at):
        old = i - d * have
        u = _draw(base, 2 * step, sample)
        rare = weight <= np.minimum(old / 8, FEW)
        run = ~rare & (old >= RUNS)
        more, new = np.ones(len(at), dtype=np.int64), (u * (weight + old) < weight).astype(np.int64)
        if rare.any():
            w, x = weight[rare], old[rare] + (weight[rare] - 1) / 2
            with np.errstate(over="ignore"):
                skip = np.minimum(x * np.expm1(-np.log(u[rare]) / w), 1e15).astype(np.int64)
            more[rare] = skip + 1
            new[rare] = i[rare] + skip < some[rare]
        if run.any():
            n = np.minimum(i[run] // 8, some[run] - i[run])
            w = weight[run]
            p = w / (w + old[run])
            p = w / (w + old[run] + n / 2 * (1 - d * p))  # half-way through the run
            z = np.sqrt(-2 * np.log(u[run])) * np.cos(2 * np.pi * _draw(base[run], 2 * step + 1, sample))
            more[run] = n
            new[run] = np.clip(np.rint(n * p + z * np.sqrt(n * p * (1 - p))), 0, n)
        have, i, step = have + new, i + more, step + 1
        go = some > i
        if not go.all():
            t[at[~go]] = have[~go]
            at, some, weight, base, have, i = at[go], some[go], weight[go], base[go], have[go], i[go]
    return t


REPLY = "block long, kind int, bucket int, values array<binary>, totals array<double>"


def _reply(rows: list[tuple]) -> pa.Table:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.float64()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "kind", "bucket", "values", "totals"])


def _gathered(t: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, their sizes, distinct keys, places of all entries among them; entries in block order."""
    order = np.argsort(t["block"].to_numpy(), kind="stable")
    t = t.take(pa.array(order))
    keys = [expand_keys(k) for k in t["keys"].to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return t["block"].to_pylist(), np.array([len(k) for k in keys]), distinct, at, t


def _count(t: pa.Table) -> pa.Table:
    """Totals of the training counts; for pairs also which block owns each one: the first that has it."""
    blocks, sizes, distinct, at, t = _gathered(t)
    kind, bucket = t["kind"][0].as_py(), t["bucket"][0].as_py()
    n = np.concatenate([expand(a, "<i4") for a in t["a"].to_pylist()])
    c = np.bincount(at, weights=n, minlength=len(distinct)).astype(np.int64)
    own = np.zeros(len(at), dtype=np.uint8)
    own[np.unique(at, return_index=True)[1]] = 1
    rows, lo = [], 0
    for block, size in zip(blocks, sizes.tolist(), strict=True):
        rows.append((block, kind, bucket, [squeeze(c[at[lo : lo + size]].astype("<i4")), squeeze(own[lo : lo + size])], None))
        lo += size
    rows.append((-1, kind, bucket, None, [float(c.sum()), float((c > 0).sum()), float((c == 1).sum()), float((c == 2).sum())]))
    return _reply(rows)


def _gather_tables(d0: float, base: float) -> object:
    """Reducer of the words' messages of one sample: tables in the word's own restaurant, customers and tables of the word in the parent."""

    def run(t: pa.Table) -> pa.Table:
        blocks, sizes, distinct, at, t = _gathered(t)
        kind, bucket = t["kind"][0].as_py(), t["bucket"][0].as_py()
        own = np.bincount(at, weights=np.concatenate([expand(a, "<i4") for a in t["a"].to_pylist()]), minlength=len(distinct)).astype(np.int64)
        dish = np.bincount(at, weights=np.concatenate([expand(b, "<i4") for b in t["b"].to_pylist()]), minlength=len(distinct)).astype(np.int64)
        top = tables(dish, np.full(len(dish), base), d0, distinct, kind)
        rows, lo = [], 0
        for block, size in zip(blocks, sizes.tolist(), strict=True):
            x = at[lo : lo + size]
            rows.append((block, kind, bucket, [squeeze(v[x].astype("<i4")) for v in (own, dish, top)], None))
            lo += size
        rows.append((-1, kind, bucket, None, [float(dish.sum()), float(top.sum())]))
        return _reply(rows)

    return run


def _values(t: pa.Table, kind: int, dtypes: tuple[str, ...]) -> list[np.ndarray]:
    """The replies of one kind to a block, joined in the buckets' order."""
    rows = sorted(((r["bucket"], r["values"]) for r in t.filter(pc.equal(t["kind"], kind)).select(["bucket", "values"]).to_pylist()), key=lambda r: r[0])
    return [np.concatenate([expand(v[i], dt) for _, v in rows]) for i, dt in enumerate(dtypes)]


WORDS_KIND, PAIRS_KIND = 0, 1


def _totals(replies: DataFrame) -> dict[int, np.ndarray]:
    rows = replies.where("block = -1").groupBy("kind").agg(*(F.sum(F.get(F.col("totals"), F.lit(i))).alias(f"t{i}") for i in range(4))).collect()
    return {r["kind"]: np.array([r[f"t{i}"] or 0.0 for i in range(4)]) for r in rows}


def score(docs: DataFrame, theta: float = THETA, samples: int = SAMPLES, burn_in: int = BURN_IN) -> DataFrame:
    """Log10 probability of every text under a model of the texts that are not held out.

    docs: doc_id, text, held_out. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (10 to the minus score a token).
    Tokens are lower-cased words and one end. Null text counts as empty (one token, the end); repeated rows count again; a null id stays null; other columns are not looked at. Without training texts every count is 0 and the model is uniform over one word; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), "held_out")
    raw = stored(_blocks(d), "model-blocks-raw")
    n_blocks = raw.count()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the checkpoint forgets how blocks are dealt out
    try:
        blocks = checkpoint(raw.repartition(max(shuffle_width(spark), -(-n_blocks // 4)), "block"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    discard(raw)
    collected(spark)  # the shuffle that dealt the blocks out goes before the messages come
    buckets = 1 << max(0, (max(1, n_blocks) // BLOCKS_A_BUCKET).bit_length())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.select(["block", "held", "sizes", "tokens", "words"]).to_pylist():
                x = Block(r["held"], r["sizes"], r["tokens"], r["words"])
                yield _messages(WORDS_KIND, r["block"], x.words, 64, buckets, x.word_train)
                yield _messages(PAIRS_KIND, r["block"], x.keys, 48, buckets, x.pair_train)

    counted = stored(blocks.mapInArrow(emit, MESSAGE).groupBy("kind", "bucket").applyInArrow(_count, REPLY), "model-counts")
    total = _totals(counted)
    zero = np.zeros(4)
    n, v, w1, w2 = total.get(WORDS_KIND, zero)
    _, _, p1, p2 = total.get(PAIRS_KIND, zero)
    discount = min(0.95, max(0.05, p1 / max(1.0, p1 + 2 * p2)))
    discount0 = min(0.95, max(0.05, w1 / max(1.0, w1 + 2 * w2)))
    uniform = 1.0 / (v + 1)

    def state0(x: Block, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each context and the parent's probabilities before the first sweep."""
        return np.maximum(1, c) ** 0.9, (c + 0.5) / (n + 0.5 * (v + 1))

    def state(t: pa.Table, kind: int, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, dish, top = _values(t, kind, ("<i4", "<i4", "<i4"))
        p = (dish - discount0 * top + (theta + discount0 * totals[1]) * uniform) / (theta + totals[0])
        return own, p

    def seats(x: Block, c2: np.ndarray, own: np.ndarray, p: np.ndarray, sample: int, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Tables of the block's pairs, or of some of them: each is drawn from its own seed."""
        alpha = (theta + discount * own[x.u[some]]) * p[x.w[some]]
        return tables(c2[some], alpha, discount, x.keys[some], sample)

    def load(left: pa.Table, right: pa.Table) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
        r = left.select(["held", "sizes", "tokens", "words"]).to_pylist()[0]
        x = Block(r["held"], r["sizes"], r["tokens"], r["words"])
        c, _ = _values(right, WORDS_KIND, ("<i4", "u1"))
        c2, own = _values(right, PAIRS_KIND, ("<i4", "u1"))
        return x, c, c2, own

    known: dict[int, np.ndarray] = {}

    def sweep(replies: DataFrame, before: int | None, kind: int) -> DataFrame:
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            x, c, c2, mine = load(left, right)
            tab, p = state0(x, c) if before is None else state(right, before, known[before])
            mine = np.flatnonzero(mine)
            t = seats(x, c2, tab, p, kind, mine)
            return pa.Table.from_batches([_messages(kind, key[0].as_py(), x.words, 64, buckets, np.bincount(x.u[mine], weights=t, minlength=len(x.words)), np.bincount(x.w[mine], weights=t, minlength=len(x.words)))])

        msgs = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, MESSAGE)
        base = (theta + discount0 * v) * uniform
        out = stored(msgs.groupBy("kind", "bucket").applyInArrow(_gather_tables(discount0, base), REPLY), "model-tables")
        known.update(_totals(out))
        return out

    counts = counted.where("block >= 0")
    first_kept = PAIRS_KIND + 1 + burn_in
    # The last sweep before the first sample, then the samples: the states that the scores come from.
    needed: list[DataFrame] = []
    last, state_kind = None, None
    for kind in range(PAIRS_KIND + 1, first_kept + samples):
        got = sweep(counts if last is None else counts.unionByName(last.where("block >= 0")), state_kind, kind)
        if last is not None and kind < first_kept:
            discard(last)
        if kind >= first_kept - 1:
            needed.append(got)
        last, state_kind = got, kind
    replies = counts
    for got in needed:
        replies = replies.unionByName(got.where("block >= 0"))

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x, c, c2, _ = load(left, right)
        tab, p = state(right, first_kept - 1, known[first_kept - 1]) if burn_in else state0(x, c)
        prob = np.zeros(len(c2))
        for k in range(first_kept, first_kept + samples):
            t = seats(x, c2, tab, p, k)
            tab, p = state(right, k, known[k])
            prob += (np.maximum(0, c2 - discount * t) + (theta + discount * tab[x.u]) * p[x.w]) / (theta + c[x.u])
        logp = np.log10(prob / samples)[x.pair_of]
        base = np.log10((c + 1) / (n + v + 1))[x.tok]
        first = np.concatenate(([0], np.cumsum(x.sizes)[:-1]))
        total_, base_, hits = np.add.reduceat(logp, first), np.add.reduceat(base, first), np.add.reduceat((c > 0)[x.tok].astype(np.int64), first)
        return pa.table({"doc_id": left["ids"].combine_chunks().flatten(), "held_out": pa.array(x.held), "n_tokens": pa.array(x.sizes.astype(np.int64)), "n_known": pa.array(hits), "train_tokens": pa.array(np.full(len(first), int(n))), "base_score": pa.array(base_), "score": pa.array(total_), "perplexity": pa.array(10 ** np.minimum(300.0, -total_ / x.sizes))})

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_documents(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """score() with the rows held out whose crc32(doc_id as text) modulo modulus is 2."""
    return score(docs.withColumn("held_out", held_out("doc_id", modulus)))
