"""Static binary fuse filters (three-wise, 8-bit fingerprints) in numpy.

``build(keys)`` gives one immutable blob for a set of distinct 64-bit keys; ``contains(blob, keys)``
tells for each key whether it may be in the set. No key of the set is ever missed; other keys pass
with a chance of about 1/256. Peeling runs in rounds over whole arrays: within a round every key
owns a slot that no other remaining key uses, so a round can be solved at once.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from cartwise.llm.common import mix

_HEAD = struct.Struct("<QIII")


def _sizes(n: int) -> tuple[int, int]:
    """Segment length and number of first segments for ``n`` keys."""
    if n <= 1:
        return 4, 1
    segment = 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25))
    segment = min(max(segment, 4), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n))
    count = max(1, math.ceil(n * factor / segment) - 2)
    return segment, count


def _slots(h: np.ndarray, segment: int, count: int) -> np.ndarray:
    """Three slots per hash, in three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    base = first * np.uint64(segment)
    return np.stack(
        [
            base + (h & mask),
            base + np.uint64(segment) + ((h >> np.uint64(18)) & mask),
            base + np.uint64(2 * segment) + (mix(h) & mask),
        ]
    ).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(7)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    keys = np.unique(np.asarray(keys).astype(np.uint64, copy=False))
    n = len(keys)
    segment, count = _sizes(n)
    for seed in range(1, 1000):
        if seed % 10 == 0:  # a little more room after many bad seeds
            count += max(1, count // 10)
        size = segment * (count + 2)
        h = mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        slots = _slots(h, segment, count)
        order = _peel(slots, size)
        if order is not None:
            break
    else:
        raise RuntimeError("no filter found")
    table, prints = np.zeros(size, np.uint8), _prints(h)
    for of, slot in reversed(order):
        table[slot] = 0
        table[slot] = prints[of] ^ table[slots[0, of]] ^ table[slots[1, of]] ^ table[slots[2, of]]
    return _HEAD.pack(n, seed, segment, count) + table.tobytes()


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    n = slots.shape[1]
    degree = np.bincount(slots.ravel(), minlength=size)
    owner = np.zeros(size, np.int64)
    for row in slots:
        np.bitwise_xor.at(owner, row, np.arange(n))
    order, left = [], n
    ready = np.flatnonzero(degree == 1)
    while len(ready):
        of, where = np.unique(owner[ready], return_index=True)
        order.append((of, ready[where]))
        left -= len(of)
        touched = slots[:, of].ravel()
        np.subtract.at(degree, touched, 1)
        np.bitwise_xor.at(owner, touched, np.tile(of, 3))
        touched = np.unique(touched)
        ready = touched[degree[touched] == 1]
    return order if left == 0 else None


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    n, seed, segment, count = _HEAD.unpack_from(blob)
    keys = np.asarray(keys).astype(np.uint64, copy=False)
    if n == 0:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=_HEAD.size)
    h = mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    slots = _slots(h, segment, count)
    return _prints(h) == table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]
