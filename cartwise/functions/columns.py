"""Scalar and array column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column | str, den: Column | str) -> Column:
    """Double quotient, NULL where the divisor is zero."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.try_divide(num.cast("double"), den.cast("double"))


def circular_hours(a: Column, b: Column) -> Column:
    """Distance of two hours of the day on a 24-hour clock."""
    gap = F.abs(a - b)
    return F.least(gap, 24 - gap)


def mean_of_known(*columns: Column) -> Column:
    """Row-wise mean over the non-NULL columns."""
    known = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0)), known)


def clip(p: Column, eps: float = 1e-15) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def log_loss_term(label: Column, p: Column) -> Column:
    """Negative log likelihood of one 0/1 label under a clipped probability."""
    p = clip(p)
    y = label.cast("double")
    return -(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p))


def pad(array: Column, width: int) -> Column:
    """First ``width`` elements of an integer array, filled up with zeros."""
    missing = F.greatest(F.lit(width) - F.size(array), F.lit(0))
    return F.concat(F.slice(array, 1, width), F.array_repeat(F.lit(0), missing))


def padded_length(array: Column, width: int) -> Column:
    return F.least(F.size(array), F.lit(width))


def shift_left(array: Column) -> Column:
    """Cyclic shift by one: every element is replaced by its successor."""
    rest = F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0)))
    return F.when(F.size(array) <= 1, array).otherwise(F.concat(rest, F.slice(array, 1, 1)))


def without_last(array: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))


def one_hot(value: Column, depth: int) -> Column:
    """0/1 vector; values outside 0 … depth-1 give all zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: (i == value).cast("int"))


def encode_nested(nested: Column) -> Column:
    """Text form of an id list per order: ``_`` inside an order, a space between orders."""
    return F.array_join(
        F.transform(nested, lambda inner: F.array_join(inner.cast("array<string>"), "_")), " "
    )


def decode_nested(text: Column) -> Column:
    return F.transform(F.split(text, " "), lambda inner: F.split(inner, "_").cast("array<bigint>"))


def fbeta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    b2 = float(beta * beta)
    return F.try_divide((1.0 + b2) * tp, (1.0 + b2) * tp + fp + b2 * fn)


def id_bucket(column: Column, buckets: int = 100) -> Column:
    """Repeatable pseudo-random bucket of an integer id (a linear congruential step)."""
    low = F.pmod(column, F.lit(2147483648))
    return F.pmod(F.floor(F.pmod(low * 1103515245 + 12345, F.lit(2147483648)) / 65536), F.lit(buckets))
