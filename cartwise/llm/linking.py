"""From band keys to exact components without all pairs of a bucket.

Items that share a band key lie in one bucket. In a first round every item meets only the centre of
each of its buckets and its most promising centre is verified; links found become components. Then
only pairs that share a bucket but still lie in different components are left. While other centres
close many of them, further rounds follow. What is left is compared in full, so a pair that shares a
bucket is never given up: small buckets pair by pair, large ones in cells of two blocks of items, of
which only the pairs that may be links come out. Inside a component nothing is compared any more,
which is what keeps large groups of near copies cheap.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import narrow
from cartwise.llm.components import UnionFind, components
from cartwise.session import materialize

#: Another round with other centres pays while the open pairs outnumber all bucket rows so often and
#: the last round closed at least half of them.
OPEN_PER_ROW, MOST_ROUNDS = 8, 12
#: Buckets above this size are compared in cells of two blocks of about ``BLOCK`` items.
SMALL_BUCKET, BLOCK = 16, 512

#: Sets of many bodies at once.
ToSets = Callable[[list[str]], list[np.ndarray]]
#: Tells which of the item pairs (i of the first list, j of the second) may be links.
Compare = Callable[[list, list, np.ndarray, np.ndarray], np.ndarray]


def shared_buckets(items: DataFrame) -> DataFrame:
    """Distinct (key, cls) of keys that different items of ``items`` (cls, bands) have."""
    rows = items.select(F.explode("bands").alias("key"), "cls")
    several = rows.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high")
    keys = materialize(several.select("key"), "bucket-keys")
    return materialize(narrow(rows, keys, ["key"]).distinct(), "buckets")


def verified(
    pairs: DataFrame, bodies: DataFrame, to_sets: ToSets, percent: int
) -> DataFrame:
    """The rows of ``pairs`` (a, b), a stored table, with 100 * intersection >= percent * union.

    Pairs that hang together are verified together, so that a body moves once for many pairs: small
    sets of candidates share a cell, large ones are cut into cells of two blocks. A cell holds about
    two blocks of bodies, and only bodies that one of its pairs needs.
    """
    group = materialize(components(pairs), "candidate-groups")
    sizes = group.groupBy("component").agg(F.count("*").alias("size"))
    shared = max(1, -(-group.count() // BLOCK))
    placed = group.join(sizes, "component").select(
        F.col("id").alias("cls"), "component", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    )
    mine = placed.select(F.col("cls").alias("a"), "component", "blocks")

    def block(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.col("blocks")).cast("int")

    celled = materialize(
        pairs.select("a", "b")
        .join(mine, "a")
        .select(
            F.when(F.col("blocks") > 1, F.col("component"))
            .otherwise(F.pmod(F.xxhash64("component"), F.lit(shared)))
            .alias("cell"),
            F.when(F.col("blocks") > 1, F.least(block("a"), block("b"))).otherwise(-1).alias("low"),
            F.when(F.col("blocks") > 1, F.greatest(block("a"), block("b"))).otherwise(-1).alias("high"),
            "a",
            "b",
        ),
        "pair-cells",
    )
    where = ["cell", "low", "high"]
    members = (
        celled.select(*where, F.col("a").alias("cls"))
        .unionByName(celled.select(*where, F.col("b").alias("cls")))
        .distinct()
        .join(bodies, "cls")
        .select(*[(F.col(c) + 0).alias(f"m_{c}") for c in where], "cls", "body")
    )

    def check(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        sets = dict(zip(there["cls"].tolist(), to_sets(there["body"].tolist()), strict=True))
        pairs_here = zip(asked["a"].tolist(), asked["b"].tolist(), strict=True)
        keep = [_similar(sets[a], sets[b], percent) for a, b in pairs_here]
        return asked.loc[np.array(keep, bool), ["a", "b"]]

    return (
        celled.groupBy(*where)
        .cogroup(members.groupBy("m_cell", "m_low", "m_high"))
        .applyInPandas(check, "a long, b long")
    )


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """Common values of two sorted arrays of distinct values."""
    both = np.concatenate([p, q])
    both.sort(kind="stable")  # equal neighbours are common
    return int((both[1:] == both[:-1]).sum())


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    small, large = min(len(p), len(q)), max(len(p), len(q))
    if not small or 100 * small < percent * large:  # the smaller set bounds what they can share
        return False
    common = _common(p, q)
    return 100 * common >= percent * (len(p) + len(q) - common)


class _Cell:
    """Rows of two blocks of one bucket and the pairs of them that lie in different parts."""

    def __init__(self, rows: pd.DataFrame):
        own = rows["block"].to_numpy() == rows["low"].to_numpy()
        self.first = rows[own]
        self.second = self.first if rows["low"].iloc[0] == rows["high"].iloc[0] else rows[~own]
        self.a = self.first["cls"].to_numpy(np.int64)
        self.b = self.second["cls"].to_numpy(np.int64)
        open_ = self.first["part"].to_numpy()[:, None] != self.second["part"].to_numpy()[None, :]
        if self.second is self.first:
            open_ &= self.a[:, None] < self.b[None, :]
        self.i, self.j = np.nonzero(open_)

    def narrow(self, keep: np.ndarray) -> None:
        self.i, self.j = self.i[keep], self.j[keep]

    def lists(self, column: str) -> tuple[list, list]:
        x = self.first[column].tolist()
        return x, x if self.second is self.first else self.second[column].tolist()

    def screen(self, compare: Compare, key: int) -> None:
        """Keep pairs that may be links and whose first common bucket is this one."""
        if len(self.i) and len(self.b):
            self.narrow(compare(*self.lists("sig"), self.i, self.j))
        if len(self.i):
            x, y = (np.stack(v) for v in self.lists("bands"))
            same = x[self.i] == y[self.j]
            self.narrow(x[self.i, same.argmax(axis=1)] == key)

    def links(self, to_sets: ToSets, percent: int) -> pd.DataFrame:
        """Links that join the cell's items; pairs that others have joined already are left out."""

        def needed(bodies: list[str], at: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
            sets = dict(zip(at.tolist(), to_sets([bodies[k] for k in at.tolist()]), strict=True))
            sizes = np.zeros(len(bodies), np.int64)
            sizes[at] = [len(s) for s in sets.values()]
            return sets, sizes

        x, y = self.lists("body")
        if self.second is self.first:
            sets_x, size_x = needed(x, np.unique(np.concatenate([self.i, self.j])))
            sets_y, size_y = sets_x, size_x
        else:
            (sets_x, size_x), (sets_y, size_y) = needed(x, np.unique(self.i)), needed(y, np.unique(self.j))
        # The smaller set bounds what two can share.
        small, large = np.minimum(size_x[self.i], size_y[self.j]), np.maximum(size_x[self.i], size_y[self.j])
        self.narrow((small > 0) & (100 * small >= percent * large))
        joined, out = UnionFind(), []
        part_a, part_b = (f["part"].to_numpy(np.int64) for f in (self.first, self.second))
        for i, j in zip(self.i.tolist(), self.j.tolist(), strict=True):
            p, q = int(part_a[i]), int(part_b[j])
            if joined.find(p) != joined.find(q) and _similar(sets_x[i], sets_y[j], percent):
                joined.union(p, q)
                out.append((int(self.a[i]), int(self.b[j])))
        return pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)


def _in_cells(
    large: DataFrame,
    bodies: DataFrame,
    to_sets: ToSets,
    percent: int,
    payload: DataFrame | None,
    compare: Compare | None,
) -> DataFrame:
    """Links (a, b) between different parts of the same large bucket.

    A row of a bucket of n items goes to n / ``BLOCK`` cells. With ``payload`` and ``compare`` the
    cells are screened first, and only items with a pair left come back with their bodies. A pair is
    verified in the first of its common buckets alone, and no row is written for pairs that are not
    links.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = (
        large.withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls", "part")
    )
    where = ["key", "low", "high"]
    if compare is not None:

        def pick(rows: pd.DataFrame) -> pd.DataFrame:
            cell = _Cell(rows)
            cell.screen(compare, int(rows["key"].iloc[0]))
            kept = [cell.first.iloc[np.unique(cell.i)], cell.second.iloc[np.unique(cell.j)]]
            return pd.concat(kept)[[*where, "block", "cls", "part"]].drop_duplicates("cls")

        kinds = "key long, low int, high int, block int, cls long, part long"
        hot = placed.join(payload, "cls").groupBy(*where).applyInPandas(pick, kinds)
        placed = materialize(hot, "open-cells").join(payload, "cls")

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        cell = _Cell(rows)
        if compare is not None:
            cell.screen(compare, int(rows["key"].iloc[0]))
        return cell.links(to_sets, percent)

    bodied = placed.join(bodies, "cls")
    if compare is not None:
        return bodied.groupBy(*where).applyInPandas(check, "a long, b long")
    # Cells of short bodies are many and small: so many of them as hold a few blocks are handed over together.
    rows = large.agg(F.sum(blocks)).first()[0] or 0
    together = F.pmod(F.xxhash64(*where), F.lit(max(1, -(-rows // (4 * BLOCK)))))

    def check_all(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([check(cell) for _, cell in rows.groupby(where, sort=False)])

    return bodied.groupBy(together).applyInPandas(check_all, "a long, b long")


def link(
    buckets: DataFrame,
    bodies: DataFrame,
    to_set: Callable[[str], np.ndarray],
    percent: int,
    screen: Callable[[DataFrame], DataFrame] | None = None,
    payload: DataFrame | None = None,
    compare: Compare | None = None,
    to_sets: ToSets | None = None,
) -> DataFrame:
    """(id, component) of all items that are linked to another one.

    ``to_sets`` gives what ``to_set`` gives for each of many bodies.

    ``screen`` maps candidate pairs (a, b) to (a, b, matches) and may leave hopeless ones out; inside
    large buckets ``compare`` does so on ``payload`` (cls, sig, bands).
    """
    if to_sets is None:

        def to_sets(texts: list[str]) -> list[np.ndarray]:
            return [to_set(t) for t in texts]

    links = tried = parts = None
    rows, before = buckets.count(), None
    for turn in range(MOST_ROUNDS + 1):
        if parts is None:
            now = buckets.withColumn("part", F.col("cls"))
        else:
            known = parts.select(F.col("id").alias("cls"), "component")
            now = buckets.join(known, "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("part"))
        per_part = now.groupBy("key", "part").agg(F.count("*").alias("n"))
        open_keys = per_part.groupBy("key").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("parts")
        ).filter("parts > 1")
        now = materialize(
            now.join(
                open_keys.select("key", "n", ((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("open")), "key"
            ),
            "open-buckets",
        )
        facts = now.groupBy("key").agg(F.count("*").alias("n"), F.first("open").alias("open")).agg(F.sum("n"), F.sum("open")).first()
        if not facts[0]:
            break
        slow = before is not None and facts[1] > before / 2
        last = turn > 0 and (facts[1] <= OPEN_PER_ROW * rows or slow or turn == MOST_ROUNDS)
        before = facts[1]
        if last:
            small = now.filter(F.col("n") <= SMALL_BUCKET)
            other = small.select("key", F.col("cls").alias("b"), F.col("part").alias("part_b"))
            found = (
                small.select("key", F.col("cls").alias("a"), "part")
                .join(other, "key")
                .filter((F.col("a") < F.col("b")) & (F.col("part") != F.col("part_b")))
            )
        else:
            centre = now.groupBy("key").agg(
                F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), "cls", "part")).alias("c")
            )
            found = now.join(centre, "key").filter(F.col("part") != F.col("c.part")).select(
                F.col("cls").alias("item"), F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")
            )
        pairs = found.select("a", "b").distinct() if last else found.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        if screen is not None:
            pairs = screen(pairs)
        if not last:
            order = F.col("matches") if screen is not None else F.xxhash64("a", "b")
            pairs = pairs.groupBy("item").agg(F.max(F.struct(order.alias("o"), "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        pairs = materialize(pairs.select("a", "b"), "pairs")
        good = verified(pairs, bodies, to_sets, percent)
        if last:
            large = now.filter(F.col("n") > SMALL_BUCKET).select("key", "cls", "part", "n")
            good = good.unionByName(_in_cells(large, bodies, to_sets, percent, payload, compare))
        good = materialize(good, "verified")
        links = good if links is None else links.unionByName(good)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if last and good.isEmpty():
            break
        parts = materialize(components(links), "components")
        if last:
            break
    if parts is None:
        return buckets.select(F.col("cls").alias("id"), F.col("cls").alias("component")).limit(0)
    return parts
