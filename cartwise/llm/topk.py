"""Exact top-k by inner product with pivot-table elimination.

Vectors become integers, ``floor(scale * x)``, and a query's score with a vector is their integer
inner product. Inner products are turned into distances: every vector gets one more component so
that all have the same length ``M``, queries get 0 there, and then
``distance² = |q|² + M² - 2 * score``. A table holds every vector's distances to the pivots. By the
triangle inequality the largest difference between a query's and a vector's distances to any pivot
is a lower bound of their distance, hence an upper bound of the score. Vectors are kept in blocks by
their nearest pivot. A query visits blocks, and inside a block candidates, in the order of their
bounds and stops for good once the best remaining bound is below its k-th score; ties go on, so that
the smaller id can win.

Query blocks and vector groups meet as (block, group) cells, each a task's small unit of work: a
vector is copied once per query block and a query once per group. Pivots come from a bounded sample
of ``SAMPLE`` vectors; every vector is indexed, and the result does not depend on the pivots.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part.
Only vectors of one length are compared. Rows that repeat an id and vector count once; one id with
several vectors keeps them all, and a query never meets its own id. Null ids take no part. Integer
arithmetic is exact: where doubles might round, Python integers are used; a score beyond 64 bits is
an error. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.session import materialize

K, SCALE, PIVOTS, SAMPLE = 10, 1024, 48, 2048
#: Queries of a block and vectors of a group on average.
QUERY_BLOCK, GROUP_ROWS, LEAST_GROUPS = 512, 8192, 16


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double> of whole numbers) of the rows that take part, each once."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    fine = (
        F.col(id_col).isNotNull()
        & v.isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    return rows.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")).distinct()


def _lift(v: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(longest * longest - (v * v).sum(axis=1), 0))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first from the vector farthest from the mean."""
    if not len(sample):
        return sample
    at = int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmax())
    chosen, near = [at], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        at = int(near.argmax())
        if near[at] == 0:
            break
        chosen.append(at)
    return sample[chosen]


class Index:
    """Vectors of one group, in blocks by nearest pivot, with their pivot table."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, longest: float):
        lifted = _lift(v, longest)
        to_pivots = _distances(lifted, pivots)
        nearest = to_pivots.argmin(axis=1)
        order = np.lexsort((ids, nearest))
        self.ids, self.v, self.table, self.longest, self.pivots = ids[order], v[order], to_pivots[order], longest, pivots
        starts = np.flatnonzero(np.r_[True, np.diff(nearest[order]) != 0])
        self.blocks = list(zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True))
        self.low = np.array([self.table[a:b].min(axis=0) for a, b in self.blocks])
        self.high = np.array([self.table[a:b].max(axis=0) for a, b in self.blocks])
        limit = float(np.abs(v).max(initial=0))
        self.limit = limit

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> list[int] | np.ndarray:
        if self.limit * float(np.abs(q).max(initial=0)) * len(q) < 2**53:
            return (self.v[rows] @ q).astype(np.int64)
        ints = [int(x) for x in q]
        out = [sum(int(x) * y for x, y in zip(row, ints, strict=True)) for row in self.v[rows]]
        if any(abs(s) >= 2**63 for s in out):
            raise OverflowError("an inner product does not fit a long")
        return np.array(out, np.int64)

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best, and how many candidates were evaluated."""
        norm = float((q * q).sum())
        roof = (norm + self.longest * self.longest) / 2
        slack = 1e-9 * roof + 1e-6
        to_pivots = _distances(np.append(q, 0.0)[None, :], self.pivots)[0]
        # Lower bound of the distance to anything in a block: how far outside its ring the query is.
        outside = np.maximum(np.maximum(self.low - to_pivots, to_pivots - self.high), 0).max(axis=1)
        bound = roof - outside * outside / 2 + slack
        ids, scores, seen = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for at in np.argsort(-bound, kind="stable"):
            if len(ids) == k and bound[at] < scores[-1]:
                break
            a, b = self.blocks[at]
            gap = np.abs(self.table[a:b] - to_pivots).max(axis=1)
            roofs = roof - gap * gap / 2 + slack
            order = np.argsort(-roofs, kind="stable")
            start, step = 0, 4 * k
            while start < len(order):
                if len(ids) == k and roofs[order[start]] < scores[-1]:
                    break
                some = a + order[start : start + step]
                start += step
                step *= 2
                some = some[self.ids[some] != query_id]
                seen += len(some)
                got = self._scores(some, q)
                ids, scores = np.concatenate([ids, self.ids[some]]), np.concatenate([scores, got])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
        return ids, scores, seen


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    pivots: int = PIVOTS,
    query_block: int = QUERY_BLOCK,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score, evaluated): the k best of all rows for each query row.

    ``is_query`` is a condition on ``vec_id``. ``evaluated`` counts the candidates whose score was
    computed for the query in the winner's group.
    """
    vectors = materialize(
        integer_vectors(rows, id_col, vector_col, scale).withColumn("dim", F.size("v")), "vectors"
    )
    facts = (
        vectors.groupBy("dim")
        .agg(
            F.count("*").alias("n"),
            F.sum(is_query.cast("long")).alias("queries"),
            F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square"),
        )
        .collect()
    )  # one row per vector length
    found = [
        _search_length(
            vectors.filter(F.col("dim") == r["dim"]), is_query, r, k, pivots, query_block, group_rows
        )
        for r in facts
        if r["queries"]
    ]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long, evaluated long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search_length(vectors, is_query, facts, k, pivots, query_block, group_rows) -> DataFrame:
    longest = float(np.sqrt(facts["square"]))
    blocks = -(-facts["queries"] // query_block)
    groups = max(LEAST_GROUPS, -(-facts["n"] // group_rows))
    share = min(1.0, 2.0 * SAMPLE / facts["n"])
    sample = (
        vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
        .orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id")
        .limit(SAMPLE)
        .select("v")
        .toPandas()
    )
    if not len(sample):
        sample = vectors.limit(1).select("v").toPandas()
    table = choose_pivots(_lift(_matrix(sample["v"]), longest), pivots)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    stored = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(spread, F.lit(groups)).cast("int").alias("group"),
        (F.col("vec_id") + 0).alias("vec_id"),
        F.transform("v", lambda x: x).alias("v"),
    )
    asked = vectors.filter(is_query).select(
        F.pmod(F.shiftright(spread, 8), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.col("vec_id").alias("query_id"),
        F.col("v").alias("q"),
    )

    def cell(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("query_id", "vec_id", "score", "evaluated")}
        if len(queries) and len(part):
            index = Index(part["vec_id"].to_numpy(np.int64), _matrix(part["v"]), table, longest)
            for query_id, q in zip(queries["query_id"].tolist(), _matrix(queries["q"]), strict=True):
                ids, scores, seen = index.search(query_id, q, k)
                out["query_id"] += [query_id] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
                out["evaluated"] += [seen] * len(ids)
        return pd.DataFrame(out).astype(np.int64)

    partial = (
        asked.groupBy("block", "group")
        .cogroup(stored.groupBy("block", "group"))
        .applyInPandas(cell, "query_id long, vec_id long, score long, evaluated long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", "evaluated")
    )
