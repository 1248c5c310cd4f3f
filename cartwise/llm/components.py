"""Connected components of a table of links by distributed union-find and star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.session import materialize

#: Links a task contracts at once; it bounds a worker's memory. There are as many tasks as this needs.
LOCAL_LINKS = 2_000_000


class UnionFind:
    """Union by smaller root with path halving."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[p]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a part as (member, smallest member of its local component)."""

    def out(sets: UnionFind) -> pa.RecordBatch:
        pairs = [(x, r) for x in list(sets.parent) if (r := sets.find(x)) != x]
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sets, held = UnionFind(), 0
    for batch in it:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            sets.union(a, b)
        held += batch.num_rows
        if held >= LOCAL_LINKS:
            yield out(sets)
            sets, held = UnionFind(), 0
    if held:
        yield out(sets)


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.countDistinct("a").alias("members")
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a long, b long); the smallest member names it.

    Links to oneself and null ends are ignored; repeated links change nothing. No step gathers a
    component: hot nodes meet combining aggregates and joins that AQE may split. It ends when every
    member has one link, to the smallest, which no other step changes.
    """
    proper = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    parts = -(-links.count() // LOCAL_LINKS)
    current = materialize(proper.coalesce(max(parts, 1)).mapInArrow(_contract, "a long, b long"), "links")
    before = _state(current) if parts > 1 else (0,)  # one task's forest is final
    while before[0]:
        current = materialize(_small_star(_large_star(current)), "links")
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def local_components(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """The same in one process, for tests."""
    sets = UnionFind()
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        sets.union(x, y)
    return {x: sets.find(x) for x in list(sets.parent)}
