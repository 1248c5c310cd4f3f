"""Lookup joins: many rows meet a dimension with one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(
    left: DataFrame, dim: DataFrame, keys: Sequence[str] | str, how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Join ``left`` to ``dim``, which has one row per key, whatever the sizes.

    With ``null_safe`` NULL keys meet NULL keys.

    Catalyst broadcasts a dimension whose known bytes allow it. Otherwise both sides are dealt by the
    key, and AQE splits the partitions of any number of hot keys and repeats their few dimension
    rows; the join needs no key's rows together, so a split changes nothing.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not null_safe:
        return left.join(dim, keys, how)
    other = dim.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"__{k}" for k in keys])
