"""Hard negatives: rows of another label that score close to, but safely below, an anchor's positives.

Vectors become integers, ``floor(scale * x)``, and a row's score is its inner product with the anchor.
An anchor's positives are the first rows of its label by score; for each positive, the negatives are the
first rows of other labels whose score lies between two shares of the positive's score.

**Products.** Anchors and candidates meet in cells of an anchor block and a candidate group, each a
bounded number of bytes, as ``int64`` matrices. A cell is worked off in tiles, each multiplied by Strassen's
recursion with zero padding (``strassen.py``). ``int64`` sums are exact modulo 2**64, hence exact whenever the
score fits a long; where the sizes of the numbers cannot promise that, the tile holds Python integers instead,
and a score that does not fit a long is an error.

**Heaps.** A tile's scores go into bounded heaps, one per anchor (positives) or per anchor and positive
score (the window of its negatives). Heaps merge by keeping the best of both, so cells need not know of each
other: each hands on the best few of its group, and a window merges them per anchor.

Positives only meet inside their label, so the first pass makes cells per label; the second pass makes
cells of all rows, since its window needs the positives' scores. A hot label is many cells. A vector is copied
once per anchor block and an anchor once per candidate group; blocks are filled up to ``ANCHOR_BYTES``.

Rows equal in id, label and vector are folded into one with their number before anything is multiplied, and
unfolded at the end: they count as the rows they are, as positives and negatives of others and of each
other, and each anchor row gets its own result rows.

Defined cases: rows with a null label or vector, or with a null or non-finite component, take no part (nor
does one that is infinite once scaled). Only vectors of one length are compared; an empty vector scores 0.
A null id is no anchor; as positive or negative it comes after all others of its score. Rows of one id with
other vectors or labels are rows of their own. An anchor without positives, or a positive without rows in its window
(a negative score has none), gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.strassen import multiply
from cartwise.session import materialize

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Bytes of the anchors and of the candidates of a cell, on average.
ANCHOR_BYTES, GROUP_BYTES = 8 << 20, 32 << 20
#: A group is made smaller than that, down to so many rows, to have this many tasks.
GROUP_LEAST, GROUPS = 2048, 32
#: Rows of a tile.
TILE_ANCHORS, TILE_ROWS = 256, 4096
HEAP = "owner long, positive_score long, score long, unnamed boolean, id long, cid long, copies long"


def integer_classes(
    rows: DataFrame, is_anchor: Column, id_col: str, label_col: str, vector_col: str, scale: int
) -> DataFrame:
    """(cid, vec_id, label, v, dim, copies, is_anchor): the rows taking part, equal ones as one."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    # From 2**53 on a double is whole already.
    whole = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    fine = F.col(label_col).isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return (
        rows.filter(F.coalesce(fine, F.lit(False)))
        .select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(label_col).alias("label"),
            whole.alias("v"),
            F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("is_anchor"),
        )
        .groupBy("vec_id", "label", "v", "is_anchor")
        .agg(F.count("*").alias("copies"))
        .select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("cid"))
    )


class Heap:
    """The ``k`` best entries seen: highest score, then named before unnamed, then smallest id."""

    def __init__(self, k: int):
        self.k, self.score = k, np.empty(0, np.int64)
        self.at = np.empty(0, np.int64)

    def offer(self, score: np.ndarray, at: np.ndarray, keys: tuple[np.ndarray, ...]) -> None:
        """``at`` are places in the group's ``keys`` (unnamed, id, cid)."""
        if len(self.score) == self.k:
            fit = score >= self.score[-1]
            score, at = score[fit], at[fit]
        if len(score) > 4 * self.k:
            fit = score >= np.partition(score, -self.k)[-self.k]
            score, at = score[fit], at[fit]
        if len(score):
            self._keep(np.concatenate([self.score, score]), np.concatenate([self.at, at]), keys)

    def merge(self, other: Heap, keys: tuple[np.ndarray, ...]) -> None:
        self.offer(other.score, other.at, keys)

    def _keep(self, score: np.ndarray, at: np.ndarray, keys: tuple[np.ndarray, ...]) -> None:
        unnamed, ids, cids = (key[at] for key in keys)
        # ~score falls as score rises and, unlike -score, never overflows.
        best = np.lexsort((cids, ids, unnamed, ~score))[: self.k]
        self.score, self.at = score[best], at[best]


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if dim else np.zeros((len(column), 0))


def _largest(m: np.ndarray) -> float:
    return float(np.abs(m).max(initial=0))


def product(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of whole-numbered vectors as ``int64``."""
    if anchors.shape[1] * _largest(anchors) * _largest(rows) < 2.0**62 and max(_largest(anchors), _largest(rows)) < 2.0**62:
        return multiply(anchors.astype(np.int64), rows.astype(np.int64).T)
    whole = np.frompyfunc(int, 1, 1)
    out = multiply(whole(anchors), whole(rows).T)
    if out.size and max(abs(out.max()), abs(out.min())) >= 2**63:
        raise OverflowError("an inner product does not fit a long")
    return out.astype(np.int64)


def _bounds(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _cell(k: int, low: int, high: int, same_label: bool):
    """Heaps of one anchor block over one candidate group, as rows of ``HEAP``."""

    def run(anchors: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(anchors) or not len(group):
            return pd.DataFrame({c.split(" ")[0]: [] for c in HEAP.split(", ")}).astype(np.int64).astype({"unnamed": bool})
        dim = int(anchors["dim"].iloc[0])
        a, g = _matrix(anchors["v"], dim), _matrix(group["v"], dim)
        owners, cids = anchors["owner"].to_numpy(np.int64), group["cid"].to_numpy(np.int64)
        copies = group["copies"].to_numpy(np.int64)
        keys = (group["unnamed"].to_numpy(bool), group["id"].to_numpy(np.int64), cids)
        labels, own_labels = group["label"].to_numpy(), anchors["label"].to_numpy()
        wanted = [[None]] * len(owners) if same_label else [list(map(int, s)) for s in anchors["scores"]]
        heaps = [[Heap(k) for _ in w] for w in wanted]
        for at in range(0, len(a), TILE_ANCHORS):
            for start in range(0, len(g), TILE_ROWS):
                scores = product(a[at : at + TILE_ANCHORS], g[start : start + TILE_ROWS])
                here = np.arange(start, start + scores.shape[1])
                for i, row in enumerate(scores, at):
                    if same_label:
                        # An anchor is not its own positive, but an equal row is.
                        free = (cids[here] != owners[i]) | (copies[here] > 1)
                        heaps[i][0].offer(row[free], here[free], keys)
                        continue
                    other = labels[here] != own_labels[i]
                    for heap, positive in zip(heaps[i], wanted[i], strict=True):
                        least, most = _bounds(positive, low, high)
                        fit = other & (row >= least) & (row <= most)
                        heap.offer(row[fit], here[fit], keys)
        parts = [(i, j, h) for i, hs in enumerate(heaps) for j, h in enumerate(hs) if len(h.score)]
        times = [len(h.score) for _, _, h in parts]
        at = np.concatenate([h.at for _, _, h in parts]) if parts else np.empty(0, np.int64)
        owner = np.repeat(np.array([owners[i] for i, _, _ in parts], np.int64), times)
        return pd.DataFrame(
            {
                "owner": owner,
                "positive_score": np.repeat(np.array([wanted[i][j] or 0 for i, j, _ in parts], np.int64), times),
                "score": np.concatenate([h.score for _, _, h in parts]) if parts else np.empty(0, np.int64),
                "unnamed": keys[0][at],
                "id": keys[1][at],
                "cid": cids[at],
                "copies": copies[at] - (cids[at] == owner),
            }
        )

    return run


def _cells(classes: DataFrame, anchors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Anchors and candidates of equal ``keys`` dealt to cells of bounded size.

    ``anchors`` has one row per anchor class (cid). Sizes come from one count per key.
    """
    sizes = classes.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.col("is_anchor").cast("long")).alias("asking"))
    width = 8 * F.greatest(F.col("dim"), F.lit(1))
    groups = F.greatest(
        F.ceil(F.col("rows") * width / GROUP_BYTES), F.least(F.lit(GROUPS), F.ceil(F.col("rows") / GROUP_LEAST))
    )
    facts = sizes.filter("asking > 0").select(
        *keys, groups.cast("int").alias("groups"), F.ceil(F.col("asking") * width / ANCHOR_BYTES).cast("int").alias("blocks")
    )
    facts = materialize(facts, "cells")
    spread = F.xxhash64("cid")

    def place(parts: str) -> Column:
        # Both sides of a cell need keys of one type: an int and a long are dealt out differently.
        return F.pmod(spread, F.col(parts)).cast("int")

    asked = anchors.join(facts, keys).select(
        *anchors.columns,
        place("blocks").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"),
    )
    # New names for the same columns, since both sides come from ``classes``.
    stored = classes.join(facts, keys).select(
        *[F.col(c).alias(c) for c in ("dim", "label", "v", "cid", "copies")],
        F.col("vec_id").isNull().alias("unnamed"),
        F.coalesce("vec_id", F.lit(0)).alias("id"),
        place("groups").alias("group"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    return asked.withColumnRenamed("cid", "owner"), stored, [*keys, "block", "group"]


def _first(heaps: DataFrame, owner: list[str], k: int) -> DataFrame:
    """Merge the heaps of each owner and number its first ``k`` rows, equal rows one by one, as ``rank``."""
    order = Window.partitionBy(*owner).orderBy(F.col("score").desc(), "unnamed", "id", "cid")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        heaps.withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= k)
        .withColumn("before", before)
        .filter(F.col("before") < k)
        .withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k)))))
        .withColumn("named", F.when(~F.col("unnamed"), F.col("id")))
    )


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the columns of ``rows``; ``low`` and ``high`` are percentages of the
    positive's score. ``rank`` counts the negatives of a positive from 1.
    """
    classes = materialize(integer_classes(rows, is_anchor, id_col, label_col, vector_col, scale), "classes")
    anchors = classes.filter("is_anchor").select("cid", "label", "v", "dim")

    asked, stored, keys = _cells(classes, anchors, ["dim", "label"])
    heaps = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(_cell(positives, low, high, True), HEAP)
    found = _first(heaps, ["owner"], positives).select(
        "owner", F.col("named").alias("positive_id"), F.col("score").alias("positive_score")
    )
    found = materialize(found, "positives")

    # At most as many scores as positives.
    scores = found.groupBy(F.col("owner").alias("cid")).agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    asked, stored, keys = _cells(classes, anchors.join(scores, "cid"), ["dim"])
    heaps = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(_cell(negatives, low, high, False), HEAP)
    hard = _first(heaps, ["owner", "positive_score"], negatives).select(
        "owner", "positive_score", "rank", F.col("named").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = classes.filter("is_anchor").select(F.col("cid").alias("owner"), F.col("vec_id").alias("anchor_id"), "copies")
    return (
        hard.join(found, ["owner", "positive_score"])
        .join(named, "owner")
        .withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
        )
    )
