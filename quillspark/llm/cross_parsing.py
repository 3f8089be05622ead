"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, tune

#: Pieces of text a language is learned from, and their characters: about 38,000 in all.
PIECES, PIECE = 96, 400
#: Bytes of a language's sample at most, and of all transition tables together; with many languages the samples get shorter.
SAMPLE_BYTES, TABLE_BYTES = 32_768, 256 << 20
#: Bytes of a text that are parsed as a unit; a phrase ends at a unit's end.
UNIT = 2048
#: Bytes of text that are parsed together.
TOGETHER = 2 << 20
#: Bits of difference that make one language e times as likely as another in `score`.
BITS = 32.0

#: ASCII letters in lower case; every other ASCII byte is a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def folded(text: str) -> bytes:
    """Lower-case UTF-8 bytes with a space for other ASCII characters than letters."""
    raw = text.encode("utf-8", "surrogatepass") if text.isascii() else text.lower().encode("utf-8", "surrogatepass")
    return raw.translate(_FOLD)


def automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of sample, from state 0; byte 0 separates pieces and is in no phrase.

    The strings that lead from state 0 to some state are just the substrings of the sample.
    """
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sample:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[cur] = clone
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        last = cur
    for t in nxt:
        t.pop(0, None)
    return nxt


@dataclass
class Languages:
    """Parsing tables of the languages, one after the other in `table`.

    An entry holds twice the place of the row of the next state and, in its lowest bit, whether the byte begins a phrase: where a state has no transition, the byte is read from the first state again.
    """

    names: list[str]
    table: np.ndarray
    start: np.ndarray  # place of each language's first state
    symbol: np.ndarray  # column of each byte
    bits: np.ndarray  # log2 of each sample's bytes: what a phrase costs

    def phrases(self, units: list[np.ndarray]) -> np.ndarray:
        """Phrases of each unit in each language: longest matches from left to right; a byte that is in no sample is a phrase of its own.

        All units and languages take a step together, so the work of a byte is a look into the table.
        """
        k, count = len(self.names), np.zeros((len(self.names), len(units)), dtype=np.int32)
        if not units:
            return count.T
        sizes = np.array([len(u) for u in units])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        grid = np.zeros((int(sizes[0]), len(units)), dtype=self.table.dtype)  # a row a step
        for lane, i in enumerate(order.tolist()):
            grid[: sizes[lane], lane] = self.symbol[units[i]]
        at = np.repeat(self.start[:, None], len(units), axis=1).astype(self.table.dtype)
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # lanes longer than the step
        got = np.zeros((k, len(units)), dtype=np.int32)
        for step, n in enumerate(live.tolist()):
            if n < at.shape[1]:
                at = np.ascontiguousarray(at[:, :n])
            at += grid[step, :n]
            at = self.table[at]
            got[:, :n] += at & 1
            at >>= 1
        count[:, order] = got
        return count.T


def learn(samples: dict[str, bytes]) -> Languages:
    """Tables for the samples, languages in order of their names; bounded by TABLE_BYTES, for which samples are cut if there are many."""
    names = sorted(k for k, s in samples.items() if s.strip(b"\0 "))
    most = min(SAMPLE_BYTES, TABLE_BYTES // max(1, len(names)) // (2 * 4 * 129))
    cut = {k: samples[k][:most] for k in names}
    seen = sorted(set(b"".join(cut.values())) - {0})
    width = len(seen) + 1  # column 0: bytes of no sample
    symbol = np.zeros(256, dtype=np.int32)
    symbol[seen] = np.arange(1, width)
    tables, start, at = [], [], 0
    for k in names:
        states = automaton(cut[k])
        t = np.zeros((len(states), width), dtype=np.int64)
        t[:, :] = at * 2 + 1
        for c, s in states[0].items():
            t[:, symbol[c]] = (at + s * width) * 2 + 1
        for i, to in enumerate(states[1:], 1):
            for c, s in to.items():
                t[i, symbol[c]] = (at + s * width) * 2
        tables.append(t.ravel())
        start.append(at)
        at += t.size
    table = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int64)
    return Languages(names, table.astype(np.int32 if at < 1 << 30 else np.int64), np.array(start, dtype=np.int64), symbol, np.array([math.log2(max(2, len(cut[k]))) for k in names]))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Languages learned from a bounded sample of the labelled texts: PIECES pieces of PIECE characters a language.

    Texts are dealt into PIECES buckets a language, and of each bucket one text is drawn, with chances as its length, and of it a piece at a random place; all are drawn from hashes of the text, so neither ids nor order matter and copies count once. Rows with a null language or text are left out; languages whose texts hold no letter aren't learned.
    """
    tune(docs.sparkSession)
    text, lang = docs[text_col].cast("string"), docs[lang_col].cast("string")
    uniform = lambda seed: (F.pmod(F.xxhash64(F.lit(seed), F.col("t")), F.lit(1 << 30)) + 1) / (1 << 30)
    rows = docs.select(lang.alias("lang"), text.alias("t")).where("lang is not null and t is not null and t <> ''")
    piece = F.substring("t", (uniform(2) * F.greatest(F.length("t") - PIECE + 1, F.lit(1))).cast("int") + 1, PIECE)
    drawn = rows.select("lang", F.pmod(F.xxhash64(F.lit(3), "t"), F.lit(PIECES)).alias("bucket"), F.struct((-F.log(uniform(1)) / F.length("t")).alias("key"), piece.alias("piece")).alias("drawn"))
    first = drawn.groupBy("lang", "bucket").agg(F.min("drawn").alias("drawn"))
    samples: dict[str, list[bytes]] = {}
    for r in first.orderBy("lang", "bucket").collect():  # PIECES rows a language at most
        samples.setdefault(r["lang"], []).append(re.sub(rb" +", b" ", folded(r["drawn"]["piece"])))
    return learn({k: b"\0".join(v) for k, v in samples.items()})


def decide(phrases: np.ndarray, n_bytes: np.ndarray, model: Languages) -> tuple[np.ndarray, np.ndarray]:
    """The language with the fewest bits a byte (phrases by the bits of a place in the sample; ties: the first by name) and its share of exp(-bits / BITS)."""
    bits = phrases * model.bits[None, :]
    rate = bits / np.maximum(n_bytes, 1)[:, None]
    best = rate.argmin(axis=1)
    weight = np.exp(-(bits - bits.min(axis=1, keepdims=True)) / BITS)
    return best, 1 / weight.sum(axis=1)


def identify(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text by cross-parsing: (id, lang_pred, score, n_phrases, bits_per_byte).

    A text is lowered, what is no letter becomes one space, and it is cut into the longest phrases that the automaton of each language's sample holds; the language needing the fewest phrases, normalised by what a phrase costs in its sample and by the text's bytes, wins. Phrases don't cross the ends of units of UNIT bytes, which bounds memory for texts of any length.
    Texts that are null, empty or without a letter, or any text if no language was learned, are `und` with score 0. Equal texts get equal results; repeated rows are kept, null ids too; an empty table gives none; other columns aren't looked at.
    """
    spark = docs.sparkSession
    tune(spark)
    sent = spark.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for ids, texts in text_batches(batches, TOGETHER):
            units, owner, size = [], [], np.zeros(len(texts), dtype=np.int64)
            for i, t in enumerate(texts):
                if not m.names or not any(map(str.isalpha, t)):
                    continue
                raw = np.frombuffer(folded(t), dtype=np.uint8)
                space = raw == 32
                raw = raw[~(space & np.concatenate(([True], space[:-1])))]
                size[i] = len(raw)
                parts = [raw[k : k + UNIT] for k in range(0, len(raw), UNIT)]
                units += parts
                owner += [i] * len(parts)
            phrases = np.zeros((len(texts), len(m.names)), dtype=np.int64)
            # Few enough units at a time that a step's lanes stay in the cache.
            for lo in range(0, len(units), 4096):
                np.add.at(phrases, owner[lo : lo + 4096], m.phrases(units[lo : lo + 4096]))
            known = size > 0
            if m.names:
                best, share = decide(phrases, size, m)
                names = [m.names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                n, rate = phrases[np.arange(len(texts)), best], phrases[np.arange(len(texts)), best] * m.bits[best] / np.maximum(size, 1)
            else:
                names, share, n, rate = ["und"] * len(texts), np.zeros(len(texts)), size, np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(np.where(known, share, 0.0), pa.float64()), pa.array(n, pa.int64()), pa.array(rate, pa.float64())], ["doc_id", "lang_pred", "score", "n_phrases", "bits_per_byte"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(f, f"`{id_col}` long, lang_pred string, score double, n_phrases long, bits_per_byte double")
