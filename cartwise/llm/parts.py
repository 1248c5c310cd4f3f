"""Grams in packed runs, dealt to parts of bounded size by their middle word.

A gram is a 63-bit key: the middle word, the word before it, the word behind it. All that is known of a
gram (its count, that of the pair it begins with, that of the pair it ends with) is found among the grams
with the same middle word, so parts that hold whole middle words need nothing from each other. A word that
alone would fill a part is cut into slices by the word before it; only the counts of the pairs it begins
must then be added up over its slices.

Runs are sorted and packed: differences of keys, byte by byte, then zstd. That takes about a third of the
bytes of plain rows, in shuffles as in files.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from cartwise.llm.common import mix

BITS = 21
MASK = (1 << BITS) - 1
#: The word behind a text's end.
NONE = MASK
#: Keys in one packed run of a stored part.
RUN_KEYS = 1 << 21


def _planes(column: np.ndarray) -> bytes:
    """All first bytes, then all second bytes, and so on."""
    wide = np.ascontiguousarray(column)
    return wide.view(np.uint8).reshape(len(wide), -1).T.tobytes()


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Non-negative 64-bit keys that ascend, and columns of the same length."""
    high = np.diff(keys.astype(np.uint64) >> np.uint64(BITS), prepend=np.uint64(0))
    low = (keys.astype(np.uint64) & np.uint64(MASK)).astype(np.uint32)
    raw = b"".join(_planes(c) for c in (high, low, *columns)) if len(keys) else b""
    return len(keys).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    """What ``pack`` was given; keys are uint64, the columns of ``kinds``."""
    n, types = int.from_bytes(data[:8], "little"), [np.dtype(k) for k in (np.uint64, np.uint32, *kinds)]
    if not n:
        return [np.empty(0, np.uint64), *[np.empty(0, t) for t in types[2:]]]
    size = n * sum(t.itemsize for t in types)
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], size), np.uint8)
    out, at = [], 0
    for t in types:
        end = at + n * t.itemsize
        out.append(np.ascontiguousarray(raw[at:end].reshape(t.itemsize, n).T).view(t).ravel())
        at = end
    high, low, *columns = out
    return [(np.cumsum(high, dtype=np.uint64) << np.uint64(BITS)) | low, *columns]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their ``n``."""
    if not len(keys):
        return keys, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")  # made for runs that are sorted already
    keys = keys[order]
    heads = heads_of(keys)
    return keys[heads], np.add.reduceat(n[order].astype(np.int64), heads)


def merged(runs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and summed counts of packed runs of (key, int64 count)."""
    found = [unpack(r, np.int64) for r in runs]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def heads_of(keys: np.ndarray) -> np.ndarray:
    """Places at which sorted keys change."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def places(sorted_keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, at): whether and where distinct sorted keys hold those asked for; ``at`` is valid if there are keys."""
    if not len(sorted_keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)
    return sorted_keys[at] == asked, at


def gram(before: np.ndarray, middle: np.ndarray, behind: np.ndarray | int) -> np.ndarray:
    return ((middle << (2 * BITS)) | (before << BITS) | behind).astype(np.uint64)


def ungram(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, middle, behind) of keys."""
    k = keys.astype(np.int64)
    return (k >> BITS) & MASK, k >> (2 * BITS), k & MASK


class Parts:
    """Which part each gram lies in; ``counts`` has how often each id is a middle word."""

    def __init__(self, counts: np.ndarray, tokens: int):
        self.slices = np.maximum(-(-counts // tokens), 1)
        cut = self.slices > 1
        self.first = np.empty(len(counts), np.int64)
        self.first[cut] = np.cumsum(self.slices[cut]) - self.slices[cut]
        own = counts[~cut]
        self.cut_parts = int(self.slices[cut].sum())
        self.first[~cut] = self.cut_parts + (np.cumsum(own) - own) // tokens
        self.number = int(self.first[~cut].max(initial=self.cut_parts - 1)) + 1

    def of(self, before: np.ndarray, middle: np.ndarray) -> np.ndarray:
        k = self.slices[middle]
        return self.first[middle] + (mix(before.astype(np.uint64)) % k.astype(np.uint64)).astype(np.int64)


def dealt(part: np.ndarray) -> Iterable[tuple[int, np.ndarray]]:
    """Each part with the places of its rows, in their order."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.uint16) if part.max() < 1 << 16 else part, kind="stable")
    heads = heads_of(part[order])
    for a, b in zip(heads, np.append(heads[1:], len(part)), strict=True):
        yield int(part[order[a]]), order[a:b]
