"""Token ids of whole Arrow columns, equal to those of ``tokenizers`` for byte-level BPE vocabularies.

Byte-level BPE cuts a text into pieces by a fixed pattern and encodes each piece by itself. Pieces are found here with
array operations on code points; ``tokenizers`` encodes each distinct piece once per worker, and a text's ids are put
together from them. Texts with a special token's string are given to ``tokenizers`` as they are.
"""

from __future__ import annotations

import os

import numpy as np
import regex

from .arrays import U64, _BASE, _INVERSE, _power, mix

LETTER, NUMBER, SPACE, OTHER = 1, 2, 4, 3
_classes: np.ndarray | None = None
_SIGN = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 2, dtype=np.uint64) * U64(2) + U64(1)


def classes() -> np.ndarray:
    """The pattern's class of each code point."""
    global _classes
    if _classes is None:
        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, what in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(kind, every):
                shift = 0x800 if m.start() >= 0xD800 else 0
                out[m.start() + shift : m.end() + (0x800 if m.end() > 0xD800 else 0)] = what
        _classes = out
    return _classes


def pieces(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts given as code points one after the other; ``bounds``: the texts' starts and the
    end. The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|space before a last space|space."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True  # also the end
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    space = kind == SPACE
    blank = points == 32
    last = np.zeros(n, bool)  # last white space of its run, before something else in the same text
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    begins = start | last  # a run of white space leaves its last one
    after = np.flatnonzero(last & blank) + 1  # what follows is taken together with that blank
    begins[after] = False
    quote = np.flatnonzero((points[:-1] == 39) & begins[:-1] & (kind[1:] == LETTER) & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):  # a quote by itself at a piece's start, then letters
        a = points[quote + 1]
        room = quote + 2 < n
        b = np.where(room & ~edge[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        for at, length in ((quote[one], 2), (quote[two & ~one], 3)):
            begins[at + 1] = False
            then = at + length
            then = then[then < n]
            begins[then] = True  # white space, another kind, another text or the rest of the letters
            inside = then[last[then - 1] & blank[then - 1]]
            begins[inside] = False
    return np.flatnonzero(begins)


class Encoder:
    """Ids of texts; keeps the ids of the pieces met, at most ``keep`` of them."""

    def __init__(self, path: str, keep: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.keep = Tokenizer.from_file(path), keep
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes, sorted
        self.where = np.zeros(0, np.int64)  # for each of them, its first id in ids
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32)

    def _learn(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, points: np.ndarray) -> None:
        if len(self.known) + len(hashes) > self.keep:
            self.clear()
        texts = [points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts, ends)]
        got = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, got), np.int64, len(got))
        where = len(self.ids) + np.concatenate([[0], np.cumsum(length)[:-1]])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), self.ids.dtype, int(length.sum()))])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.where, self.length = known[order], np.concatenate([self.where, where])[order], np.concatenate([self.length, length])[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the texts' bounds in them."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if odd:
            parts: list[np.ndarray] = []
            own = {i: np.array(self.model.encode(texts[i], add_special_tokens=False).ids, self.ids.dtype) for i in odd}
            ids, bounds = self.encode(["" if i in own else t for i, t in enumerate(texts)])
            for i in range(len(texts)):
                parts.append(own.get(i, ids[bounds[i] : bounds[i + 1]]))
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        starts = pieces(points, bounds)
        if not len(starts):
            return np.zeros(0, self.ids.dtype), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(points))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points * _SIGN[0] + _SIGN[1]) * _power(_BASE, len(points)), out=total[1:])
        hashes = mix((total[ends] - total[starts]) * _power(_INVERSE, len(points))[starts] + (ends - starts).astype(np.uint64))
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            before = len(self.known)
            self._learn(unique[new], starts[first[new]], ends[first[new]], points)
            if len(self.known) != before + new.sum():  # the store was emptied
                old = np.flatnonzero(~new)
                self._learn(unique[old], starts[first[old]], ends[first[old]], points) if len(old) else None
            at = np.searchsorted(self.known, unique)
        length, where = self.length[at][inverse], self.where[at][inverse]
        out = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.repeat(where - out[:-1], length) + np.arange(out[-1])]
        return ids, out[np.searchsorted(starts, bounds)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
