"""Words of many texts as numpy columns: no Python object for each word.

Words are runs of bytes outside ASCII white space (0x20, 0x09-0x0D); A-Z are lower-cased first.

A word's hash is a sum of 64-bit values, one for each byte at each place, that a mixer makes of
both (tabulation hashing; from place 4096 on the table's value is mixed with the number of its
round). Unlike a polynomial modulo 2**64, no structure of a word cancels in it. Two words have one
hash with odds of 2**-64; among 20 million words that is 1 in 10**5 for any two of them.

Cases: empty texts and texts of white space alone have no words (counts 0); no texts give empty columns;
bytes that are no UTF-8 are words like any other; a word may be as long as its text.
"""

from __future__ import annotations

from functools import cache

import numpy as np

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
WHITE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xC2B2AE3D27D4EB4F)


PLACES = 4096
#: Bytes of words that are hashed at once.
HASHED = 1 << 18
#: Places at which the bytes of all words are taken together.
EARLY = 24


@cache
def _table() -> np.ndarray:
    """A value for each byte at each of the first places, flat."""
    return mix(mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)))


def byte_values(data: np.ndarray, within: np.ndarray) -> np.ndarray:
    """The values of bytes at their places in their words."""
    out = _table()[(within & (PLACES - 1)) << 8 | data]
    late = np.flatnonzero(within >= PLACES)
    if len(late):
        out[late] = mix(out[late] + (within[late] >> 12).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


class Words:
    """The words of texts: `data` (lower-cased buffer), `start` and `end` of each word in it, `hash` (64 bits), `doc` and `counts` by text."""

    def __init__(self, texts: list[bytes], gap: int = 1):
        """gap: how many bytes of white space part texts (what looks that far beyond a word sees no other text)."""
        joined = (b"\n" * gap).join([b"", *texts, b""])
        self.data = np.frombuffer(joined.translate(LOWER.tobytes()), np.uint8)
        ends = np.cumsum([len(t) + gap for t in texts]) if texts else np.zeros(0, np.int64)
        black = (self.data != 0x20) & (self.data - np.uint8(0x09) > 0x0D - 0x09)
        edges = np.flatnonzero(black[1:] != black[:-1])
        self.start, self.end = edges[::2] + 1, edges[1::2] + 1
        del joined, black, edges
        self.counts = np.diff(np.searchsorted(self.start, ends), prepend=0)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.hash = np.empty(len(self.start), np.uint64)
        size = self.end - self.start
        last = np.cumsum(size)
        cuts = np.unique([*np.searchsorted(last, np.arange(0, int(last[-1]), HASHED)).tolist(), len(size)]).tolist() if len(size) else []
        for a, b in zip(cuts, cuts[1:]):  # what is worked out for each byte is held for some words alone
            self.hash[a:b] = mix(self._sums(self.start[a:b], size[a:b]) + size[a:b].astype(np.uint64))

    def _sums(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The sum of the values of each word's bytes: place by place over the words that reach it, then the rest of long words."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        out = np.zeros(len(size), np.uint64)
        for place, n in enumerate(np.searchsorted(-size, -np.arange(1, min(int(size[0]), EARLY) + 1), side="right").tolist()):
            out[:n] += _table()[place << 8 : (place + 1) << 8][self.data[start[:n] + place]]
        if n := int(np.searchsorted(-size, -EARLY)):
            own = size[:n] - EARLY
            within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            value = byte_values(self.data[np.repeat(start[:n] + EARLY, own) + within], within + EARLY)
            out[:n] += np.add.reduceat(value, np.cumsum(own) - own)
        back = np.empty_like(out)
        back[order] = out
        return back

    def tail(self, n: int) -> np.ndarray:
        """The last n bytes of each word as a number (0 before its start)."""
        out = np.zeros(len(self.start), np.int64)
        for k in range(1, n + 1):
            at = self.end - k
            out = out << 8 | np.where(at >= self.start, self.data[np.maximum(at, 0)], 0)
        return out
