"""Token counts by finite-state machines compiled from a tokenizer file.

Two deterministic transducers stand in for the tokenizer. The first reads character classes and marks where pieces begin; it runs over chunks in parallel: each chunk's map from entry state to exit state is computed for all states, the maps compose in a parallel prefix scan, and the marks follow from the true entry states. The second reads the symbols of one piece; after each symbol it knows the last token of the prefix read so far, and its transitions carry the number of tokens emitted.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytebpe
from .common import text_batches

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: White space of the pattern, as Unicode has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Endings that are pieces of their own after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# Character classes: 0 white space, 1 letter, 2 number, 3 other, 4 apostrophe, then the letters of the contractions.
_LETTERS = sorted({c for s in CONTRACTIONS for c in s})
_CLASS_OF = {c: 5 + i for i, c in enumerate(_LETTERS)}
N_CLASSES = 5 + len(_LETTERS)


class PieceScanner:
    """Marks the first character of each piece of the pattern 's|'t|'re|'ve|'m|'ll|'d|letters|number|others.

    Matches of the contractions need up to two characters of look-ahead, so the machine reads, for each position, the class and whether a contraction of one or two letters starts after an apostrophe there.
    """

    SPACE, LETTERS, NUMBER, OTHER, SKIP1, SKIP2 = range(6)
    CHUNK = 64

    def __init__(self) -> None:
        # Input symbols: 0 space, 1 letter, 2 number, 3 other, 4 apostrophe with a 1-letter ending, 5 with a 2-letter ending.
        step = np.zeros((6, 6), dtype=np.uint8)
        mark = np.zeros((6, 6), dtype=bool)
        for state in range(6):
            for sym in range(6):
                if state == self.SKIP2:
                    step[state, sym] = self.SKIP1
                    continue
                if state == self.SKIP1:
                    step[state, sym] = self.NUMBER  # a finished piece: whatever comes next begins a new one
                    continue
                if sym == 0:
                    step[state, sym] = self.SPACE
                elif sym == 1:
                    step[state, sym], mark[state, sym] = self.LETTERS, state != self.LETTERS
                elif sym == 2:
                    step[state, sym], mark[state, sym] = self.NUMBER, True
                elif sym == 3 or state == self.OTHER:  # an apostrophe inside a run of others belongs to it
                    step[state, sym], mark[state, sym] = self.OTHER, state != self.OTHER
                else:
                    step[state, sym], mark[state, sym] = (self.SKIP1 if sym == 4 else self.SKIP2), True
        self.step, self.mark = step, mark
        self.table = np.full(0x110000, 255, dtype=np.uint8)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """Class of each code point; the table fills as new ones turn up."""
        new = np.unique(codes[self.table[codes] == 255])
        for c in new.tolist():
            ch = chr(c)
            kind = unicodedata.category(ch)[0] if not 0xD800 <= c < 0xE000 else "C"
            self.table[c] = _CLASS_OF.get(ch) or (0 if ch in SPACES else 1 if kind == "L" else 2 if kind == "N" else 4 if ch == "'" else 3)
        return self.table[codes]

    def starts(self, text: str) -> np.ndarray:
        """Whether a piece begins at each character."""
        n = len(text)
        cls = self.classes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        sym = np.minimum(cls, 4)
        sym[cls >= 5] = 1
        ap = np.flatnonzero(cls == 4)
        sym[ap] = 3
        if len(ap):
            padded = np.concatenate((cls, np.zeros(2, dtype=np.uint8)))
            for ending in CONTRACTIONS:
                hit = ap[np.all([padded[ap + 1 + k] == _CLASS_OF[c] for k, c in enumerate(ending)], axis=0)]
                sym[hit] = 3 + len(ending)
        chunks = -(-n // self.CHUNK)
        grid = np.zeros(chunks * self.CHUNK, dtype=np.uint8)
        grid[:n] = sym
        grid = grid.reshape(chunks, self.CHUNK)
        maps = np.tile(np.arange(6, dtype=np.uint8), (chunks, 1))
        for k in range(self.CHUNK):
            maps = self.step[maps, grid[:, k : k + 1]]
        entry = self.scan(maps)
        out = np.empty_like(grid, dtype=bool)
        state = entry
        for k in range(self.CHUNK):
            out[:, k] = self.mark[state, grid[:, k]]
            state = self.step[state, grid[:, k]]
        return out.reshape(-1)[:n]

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Entry state of each chunk, from state 0 on: an inclusive prefix scan of map composition, by doubling."""
        maps = maps.copy()
        gap = 1
        while gap < len(maps):
            maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap], axis=1)
            gap *= 2
        return np.concatenate(([0], maps[:-1, 0])).astype(np.uint8)


class PieceCounter:
    """Transducer of one piece: reads symbols, keeps the last token of every prefix, emits counts."""

    LIMIT = 500_000

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.end = end
        rank: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.merged: dict[tuple[str, str], int] = {}
        for i, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            if a + b not in rank:
                rank[a + b] = i + 1
                self.parts[a + b] = (a, b)
            self.merged[a, b] = i + 1
        self.rank = rank
        self.longest = max((len(t.removesuffix(end)) for t in rank), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.byte_text = {b: c for c, b in bytebpe.unicode_to_byte().items()}
        self.counts: dict[str, int] = {}

    def adjacent(self, a: str, b: str) -> bool:
        """Whether the merges leave a and b side by side when they read a + b: no merge across the border may come before those that build the two."""
        found = self.pairs.get((a, b))
        if found is not None:
            return found
        x, y, bound, ok = a, b, 1 << 60, True
        while True:
            r = self.merged.get((x, y))
            if r is not None and r < bound:
                ok = False
                break
            rx, ry = self.rank.get(x, 0), self.rank.get(y, 0)
            if rx == ry == 0:
                break
            # Undo the later of the two; on the left of the border a merge of equal rank comes first.
            if rx > ry:
                bound, x = rx, self.parts[x][1]
            else:
                bound, y = ry + 1, self.parts[y][0]
        if len(self.pairs) > 2 * self.LIMIT:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def count(self, piece: str) -> int:
        """Tokens of one piece."""
        s = "".join(map(self.byte_text.__getitem__, piece.encode("utf-8", "replace")))
        n = len(s)
        last: list[str] = [""] * (n + 1)
        emitted = [0] * (n + 1)
        rank, adjacent = self.rank, self.adjacent
        for i in range(1, n + 1):
            end = self.end if i == n else ""
            for j in range(max(0, i - self.longest), i):
                t = s[j:i] + end
                if (i - j == 1 or t in rank) and (j == 0 or (last[j] and adjacent(last[j], t))):
                    last[i], emitted[i] = t, emitted[j] + 1
                    break
        return emitted[n]


class TokenCounter:
    LIMIT = 600_000

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("only BPE files with a word-end suffix can be compiled")
        self.scanner = PieceScanner()
        self.pieces = PieceCounter(model["vocab"], model["merges"], model["end_of_word_suffix"])
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_texts = special
        self.spaces = regex.compile(f"[{SPACES}]+")
        self.units: dict[str, int] = {}

    def learn(self, units: list[str]) -> None:
        """Counts of new white-space-free units: both transducers over all of them at once."""
        joined = "\n".join(units)
        marks = np.flatnonzero(self.scanner.starts(joined)).tolist()
        bounds = np.concatenate((np.cumsum([0, *[len(u) + 1 for u in units]]), []))
        marks.append(len(joined))
        counts, known = self.pieces.counts, self.units
        if len(counts) > PieceCounter.LIMIT:
            counts.clear()
        at = 0
        for k, u in enumerate(units):
            stop = int(bounds[k + 1]) - 1
            total = 0
            while at < len(marks) - 1 and marks[at] < stop:
                p = joined[marks[at] : min(marks[at + 1], stop)]
                c = counts.get(p)
                if c is None:
                    c = counts[p] = self.pieces.count(p)
                total += c
                at += 1
            known[u] = total

    def lowered(self, text: str) -> str:
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        # Letters are lowered one by one; only the final sigma depends on what stands around it.
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def split(self, text: str) -> list[str]:
        if text.isascii() or text.replace("\n", "").isprintable():
            if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return text.split()
        return [u for u in self.spaces.split(text) if u]

    def count_all(self, texts: list[str]) -> list[int]:
        out, jobs, fresh = [], [], set()
        if len(self.units) > self.LIMIT:
            self.units.clear()
        known = self.units
        for t in texts:
            extra = 0
            parts = [t]
            if self.special and any(s in t for s in self.special_texts):
                parts = self.special.split(t)
                extra = len(parts) - 1
            units = [u for p in parts for u in self.split(self.lowered(p))]
            jobs.append((extra, units))
            fresh.update([u for u in units if u not in known])
        new = sorted(fresh)
        for i in range(0, len(new), 8192):
            self.learn(new[i : i + 8192])
        for extra, units in jobs:
            out.append(extra + sum(map(known.__getitem__, units)))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """UTF-8 bytes and tokens of each text, and whether the tokens exceed limit.

    Null text counts as empty (0 bytes, 0 tokens); repeated rows stay, a null id stays null, an empty table gives an empty result, other columns are not looked at. No shuffle; lookup tables are emptied at a fixed size.
    """
    path = tokenizer or bytebpe.default_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for keys, texts in text_batches(batches):
            n = counter.count_all(texts)
            size = [len(t) if t.isascii() else len(t.encode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
