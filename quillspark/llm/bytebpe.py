"""Byte-level BPE: whole texts to ids and back, exact against the tokenizers library."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np

#: Split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def unicode_to_byte() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space of the split pattern: the Unicode property, spelled out.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class _Known(dict):
    """Ids by piece, worked out when first asked for; emptied when full."""

    LIMIT = 500_000

    def __init__(self, encode: Callable[[str], tuple[int, ...]]):
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece)
        if len(self) >= self.LIMIT:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class ByteBpe:
    """Encoder of one tokenizer file. Texts are halved down to leaves, which are encoded on their own, and the halves are joined; long pieces within them likewise."""

    #: Characters of a leaf of a text, bytes of a leaf of one piece.
    LEAF, PIECE_LEAF = 512, 64

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        u2b = unicode_to_byte()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(map(u2b.__getitem__, tok)): i for tok, i in vocab.items() if tok not in self.special}
        self._enc = tiktoken.Encoding("quillspark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.pattern = regex.compile(PATTERN.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))
        self._byte_id = [vocab[c] for c, _ in sorted(u2b.items(), key=lambda x: x[1])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (rank, id of the merged token) by pair of ids.
        self._merges = {(vocab[x], vocab[y]): (rank, vocab[x + y]) for rank, (x, y) in enumerate(merges)}
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in ranks.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.text_of = [str(i) for i in range(size)]
        self.leads_space = np.array([b[:1] == b" " for b in self.bytes_of])
        self._special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._known = _Known(lambda p: tuple(self.piece(p.encode("utf-8", "replace"))))

    def merge(self, data: bytes) -> list[int]:
        """Ids of a short piece: the pair of least rank is merged, the leftmost first, until none is left."""
        ids = list(map(self._byte_id.__getitem__, data))
        find, none = self._merges.get, (len(self._merges), -1)
        pairs = [find(p, none) for p in zip(ids, ids[1:], strict=False)]
        if len(pairs) > 4 * self.PIECE_LEAF or len(pairs) > 40 and len(set(pairs)) * 8 < len(pairs):
            ids = self._merge_large(np.array(ids, dtype=np.int64))
            pairs = [find(p, none) for p in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            ids[i : i + 2] = best[1:]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = find((ids[i], ids[i + 1]), none)
            if i:
                pairs[i - 1] = find((ids[i - 1], ids[i]), none)
        return ids

    def _merge_large(self, ids: np.ndarray) -> list[int]:
        """merge for a large window, or one that repeats itself: all places of the least pair at once, so that a text that repeats itself takes as many passes as it has different merges."""
        find, none, size = self._merges.get, (len(self._merges), -1), len(self.bytes_of)
        known: dict[int, tuple[int, int]] = {}
        while len(ids) > 1:
            keys = ids[:-1] * size + ids[1:]
            best, at = none, -1
            for k in set(keys.tolist()):
                got = known.get(k)
                if got is None:
                    got = known[k] = find(divmod(k, size), none)
                if got < best:
                    best, at = got, k
            if best is none:
                break
            places = np.flatnonzero(keys == at)
            # Places that follow each other overlap: of such a run every second one is merged, from the left.
            first = np.concatenate(([True], places[1:] != places[:-1] + 1))
            run = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
            ids[places] = best[1]
            ids = np.delete(ids, places + 1)
        return ids.tolist()

    def piece(self, data: bytes, leaf: int | None = None) -> list[int]:
        """Ids of one piece by tree concatenation: halves encoded on their own, then joined."""
        leaf = leaf or self.PIECE_LEAF
        if len(data) <= leaf:
            return self.merge(data)
        half = len(data) // 2
        return self.join_ids(self.piece(data[:half], leaf), self.piece(data[half:], leaf))

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two parts of one piece in one: a window around the join grows until its first token is the left side's and its last the right side's.

        An encoding is the right one if every two neighbours are what the merges give for their own text; with an agreed token on each side all pairs come from valid encodings.
        """
        before = after = 4
        while True:
            a, b = left[-before:], right[:after]
            ids = self.merge(b"".join(map(self.bytes_of.__getitem__, a + b)))
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            left_agrees = whole_left or len(ids) >= 2 and ids[0] == a[0]
            right_agrees = whole_right or len(ids) >= 2 and ids[-1] == b[-1]
            if left_agrees and right_agrees:
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            # Only the side that disagrees grows.
            before, after = before * (1 if left_agrees else 2), after * (1 if right_agrees else 2)

    def join(self, left: tuple[list[str], list], right: tuple[list[str], list]) -> tuple[list[str], list]:
        """The encoding of two neighbouring texts in one, from theirs, as (pieces, ids of each); left is used up.

        A window around the join is encoded anew and grows until both sides agree with it: on the left it starts where a piece of the left side does, two characters at least before the join, as no piece looks further ahead; on the right some piece of the window ends where one of the right side does, two characters before the window's end at least.
        """
        (pieces, ids), (more, more_ids) = left, right
        w = 2
        while True:
            a, b = pieces[-w:], more[:w]
            at = sum(map(len, a))
            if at >= 2 or len(a) == len(pieces):
                window = "".join(a + b)
                got = self.pattern.findall(window)
                take, skip = len(got), len(b)
                if len(b) < len(more):
                    take, end, skip, start = 0, 0, 0, at
                    while end != start or end < at:
                        if end < start or end < at:
                            if take == len(got):
                                break
                            end += len(got[take])
                            take += 1
                        else:
                            if skip == len(b):
                                break
                            start += len(b[skip])
                            skip += 1
                    if end != start or len(window) - end < 2:
                        w *= 2
                        continue
                got = got[:take]
                new = []
                start = 0
                for p in got:
                    # A long piece that is the last one on the left and the first one on the right in one is joined from their ids.
                    if len(p) > self.LEAF and start < at and start == at - len(a[-1]) and b and start + len(p) == at + len(b[0]):
                        new.append(tuple(self.join_ids(list(ids[-1]), list(more_ids[0]))))
                    else:
                        new.append(self._known[p])
                    start += len(p)
                pieces[len(pieces) - len(a) :] = got
                ids[len(ids) - len(a) :] = new
                pieces += more[skip:]
                ids += more_ids[skip:]
                return pieces, ids
            w *= 2

    def halves(self, text: str) -> tuple[list[str], list]:
        """(pieces, ids of each) of a text: of a leaf by the merges, of a longer one from its halves."""
        if len(text) <= self.LEAF:
            pieces = self.pattern.findall(text)
            return pieces, list(map(self._known.__getitem__, pieces))
        half = len(text) // 2
        return self.join(self.halves(text[:half]), self.halves(text[half:]))

    def ordinary(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        return list(chain.from_iterable(self.halves(text)[1]))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special strings inside it become their ids, as the library's default does."""
        if not self.special or not any(s in text for s in self.special):
            return self.ordinary(text)
        out: list[int] = []
        for part in self._special_pattern.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.ordinary(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def digits(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(itemgetter(*ids)(self.text_of)) if len(ids) > 1 else "".join(self.text_of[i] for i in ids)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
