"""Word shingles of whole texts as 64-bit hashes, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np
import xxhash

#: Texts are hashed in slices of about this many bytes, cut between words.
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """Polynomial hashes of byte ranges by prefix sums modulo 2**64, over random byte values."""

    def __init__(self) -> None:
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.power = self.back = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            self.power, self.back = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))])
                                     for x in (_BASE, self.inverse))

    def _slice(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        word = np.zeros(len(raw) + 2, np.int8)
        word[1:-1] = ~_SPACE[raw]
        edges = np.flatnonzero(np.diff(word))
        start, end = edges[::2], edges[1::2]
        self._grow(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.power[:len(raw)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def words(self, data: bytes) -> np.ndarray:
        if len(data) <= SLICE:
            return self._slice(data)
        parts, at = [], 0
        while at < len(data):
            stop = at + SLICE
            while stop < len(data) and not _SPACE[data[stop]]:
                stop += 1
            parts.append(self._slice(data[at:stop]))
            at = stop
        return np.concatenate(parts)

    def shingles(self, text: str | None, k: int) -> np.ndarray:
        """Distinct hashes (signed, ascending) of the ``k``-word shingles; a shorter text is one shingle, an empty one none.

        A-Z are lower-cased; words are what space, tab and line ends separate.
        """
        if not text:
            return np.zeros(0, np.int64)
        words = self.words(text.encode("utf-8", "replace").lower())  # of bytes: A-Z only
        if not len(words):
            return np.zeros(0, np.int64)
        n = max(1, len(words) - k + 1)
        h = np.full(n, min(len(words), k), np.uint64)
        for j in range(min(len(words), k)):
            h = mixed(h * _BASE + words[j:j + n])
        return np.unique(h.view(np.int64))


def set_key(shingles: np.ndarray) -> int:
    """64-bit name of a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def signature(shingles: np.ndarray) -> bytes:
    """Token bitmap: 4 to 8 bits a shingle, the bit being the shingle's low bits; a power of two wide."""
    bits = max(64, 1 << int(4 * max(1, len(shingles)) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[shingles & (bits - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()
