"""Words of many texts at once, as positions and hashes in one byte array."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Odd multipliers of the two rolling-hash lanes over bytes, and over words.
BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes whose hashes are worked out at once, and a value for each byte and the next.
CHUNK = 1 << 18
_PAIRS = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = [Powers(b) for b in BYTE_BASES]
_WORD_POWERS = [Powers(b) for b in WORD_BASES]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int, words: bool) -> np.ndarray:
    """Rabin-Karp hashes of values[starts:ends], all at once, modulo 2**64.

    With S the running sum of value * base**position, a slice's polynomial is
    (S[end] - S[start]) * base**-start, whatever its place.
    """
    up, down = (_WORD_POWERS if words else _BYTE_POWERS)[lane].get(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:], dtype=np.uint64)
    return (sums[ends] - sums[starts]) * down[starts]


class WordTable:
    """Words of a list of byte strings.

    data: the texts joined by line feeds; starts, ends: the words' places in it;
    first: for each text, and once more for the end, the index of its first word.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined, dtype=np.uint8)
        space = _SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, bounds)
        self.joined = joined

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, some CHUNK bytes at a time.

        The second lane hashes a byte with the next, not alone: bytes alone make
        polynomials modulo 2**64 that agree for some made-up long words.
        """
        out = np.empty(len(self.starts), dtype=np.uint64)
        cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(self.data), CHUNK)), len(self.starts)))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            lo, hi = self.starts[i], self.ends[j - 1]
            if lane:
                following = self.data[lo + 1 : hi + 1]
                values = _PAIRS[self.data[lo:hi] | np.where(_SPACE[following], 0, following).astype(np.uint16) << 8]
            else:
                values = self.data[lo:hi].astype(np.uint64) + np.uint64(1)
            out[i:j] = mix(rolling(values, self.starts[i:j] - lo, self.ends[i:j] - lo, lane, words=False))
        return out


def window_hashes(word_hashes: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Mixed Rabin-Karp hashes of every run of ``size`` words, also across texts."""
    n = max(0, len(word_hashes) - size + 1)
    at = np.arange(n)
    return mix(rolling(word_hashes, at, at + size, lane, words=True))
