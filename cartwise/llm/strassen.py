"""Exact integer matrix products by Strassen's recursion.

Seven products of half-sized blocks and eighteen additions replace eight products. Odd sizes get a zero row or
column, which changes no product, and the result is cut back. Arithmetic is that of the arrays' type:
``int64`` is exact modulo 2**64, so every entry that fits a long is right whatever the blocks' sums
do in between; arrays of Python integers are exact without bound.
"""

from __future__ import annotations

import numpy as np

#: Blocks with a side of at most this many rows or columns are multiplied directly.
LEAF = 32


def _even(m: np.ndarray) -> np.ndarray:
    rows, columns = m.shape[0] % 2, m.shape[1] % 2
    return np.pad(m, ((0, rows), (0, columns))) if rows or columns else m


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of integer arrays."""
    if min(*a.shape, b.shape[1]) <= leaf:
        return a @ b
    rows, columns = a.shape[0], b.shape[1]
    a, b = _even(a), _even(b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = multiply(a11 + a22, b11 + b22, leaf)
    p2 = multiply(a21 + a22, b11, leaf)
    p3 = multiply(a11, b12 - b22, leaf)
    p4 = multiply(a22, b21 - b11, leaf)
    p5 = multiply(a11 + a12, b22, leaf)
    p6 = multiply(a21 - a11, b11 + b12, leaf)
    p7 = multiply(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * m, 2 * n), a.dtype)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]
