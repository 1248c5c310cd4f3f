"""MinHash signatures, band keys, and the choice of bands."""

from __future__ import annotations

import math

import numpy as np

from cartwise.llm.common import mix


class MinHash:
    """``bands * rows`` permutations of 32-bit hashes, the same in every process."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        draws = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.factor = (draws[::2] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.mask = (draws[1::2] >> np.uint64(32)).astype(np.uint32)[:, None]
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, values: np.ndarray) -> np.ndarray:
        """Minimum of every permutation over a non-empty set of 64-bit hashes."""
        x = (values >> np.uint64(32)).astype(np.uint32)
        out = None
        for a in range(0, len(x), 2048):  # a few hundred kilobytes at a time
            low = ((x[None, a : a + 2048] ^ self.mask) * self.factor).min(axis=1)
            out = low if out is None else np.minimum(out, low)
        return out

    def signatures(self, values: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The same for many non-empty sets, one a row; a set's hashes lie from its head to the next one."""
        x = (values >> np.uint64(32)).astype(np.uint32)
        out, drawn = np.empty((len(self.mask), len(heads)), np.uint32), np.empty_like(x)
        for k, (mask, factor) in enumerate(zip(self.mask[:, 0], self.factor[:, 0], strict=True)):
            np.bitwise_xor(x, mask, out=drawn)
            np.multiply(drawn, factor, out=drawn)
            np.minimum.reduceat(drawn, heads, out=out[k])
        return np.ascontiguousarray(out.T)

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        """A signed 64-bit key per band; equal rows of one band give equal keys."""
        return self.band_keys_of(signature[None, :])[0]

    def band_keys_of(self, signatures: np.ndarray) -> np.ndarray:
        """The same for many signatures, one a row."""
        part = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(self.salt, part.shape[:2])
        for k in range(self.rows):
            key = mix(key + part[:, :, k])
        return key.view(np.int64)


def miss(bands: int, rows: int, similarity: float) -> float:
    """Chance that a pair of that similarity shares no band."""
    return (1 - similarity**rows) ** bands


def bands_for(similarity: float, rows: int, most_missed: float) -> int:
    """Fewest bands that miss a pair of that similarity with at most this chance."""
    return math.ceil(math.log(most_missed) / math.log(1 - similarity**rows))
