"""Toxicity classifier with a counterfactual penalty on identity terms.

A logistic model over hashed words, word beginnings and inner character n-grams, each counted once a
text. For every labelled text that names an identity term, a twin is made in which each such term is
replaced by the next one of its group; training adds ``counterfactual`` times the squared difference
of the two log-odds, so that swapping a neutral mention hardly moves the score.

Training reads at most ``TRAIN_ROWS`` labelled rows (a documented bound: rows with the smallest hash
of their text); hashing and twins run on executors, and one bounded matrix is fitted on the driver.
The model has ``1 << BITS`` weights at any corpus size. Scoring reads every whole text.

Defined cases: null and empty texts have no features and get the model's base rate as score. With no
labelled rows, or one class only, every score is that base rate (0 with none). Repeated rows each give
a row; repeated or contradicting labels count as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import CACHE_ENTRIES, batches

BITS, TRAIN_ROWS, THRESHOLD = 18, 12_000, 0.7
#: Groups of terms that may be exchanged for each other; a parameter of ``train``.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("gay", "lesbian", "straight", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrant", "citizen"),
    ("disabled", "blind", "deaf"),
    ("old", "young"),
)
_RUNS = re.compile(r"[^\W_]+")


class _WordFeatures(dict):
    """Feature slots of each word, remembered per worker."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_ENTRIES // 2:
            self.clear()
        mask = (1 << BITS) - 1
        keys = {"w:" + word}
        keys.update("p:" + word[:k] for k in range(3, min(7, len(word)) + 1))
        slots = self[word] = tuple({xxhash.xxh3_64_intdigest(k) & mask for k in keys})
        return slots


_FEATURES = _WordFeatures()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature slots of a whole text."""
    if not text:
        return np.empty(0, np.int32)
    slots: set[int] = set()
    for word in set(_RUNS.findall(text.lower())):
        slots.update(_FEATURES[word])
    return np.fromiter(sorted(slots), np.int32, len(slots))


def swapped(text: str, groups: Iterable[Iterable[str]] = IDENTITY_GROUPS) -> str | None:
    """The text with each identity term replaced by the next of its group, or None without any."""
    following = {a: b for g in map(tuple, groups) for a, b in zip(g, g[1:] + g[:1], strict=True)}
    low = text.lower()
    if not any(t in low for t in following):
        return None
    out = _RUNS.sub(lambda m: following.get(m.group(), m.group()), low)
    return out if out != low else None


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, slots: np.ndarray) -> float:
        z = self.bias + float(self.weights[slots].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def _ragged(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.repeat(np.arange(len(rows)), sizes)
    return at, (np.concatenate(rows) if rows else np.empty(0, np.int32)).astype(np.int64)


def evident(x: list[np.ndarray], y: np.ndarray, least: float) -> np.ndarray:
    """Slots whose share of toxic texts differs from that of others by ``least`` standard errors."""
    size, p = 1 << BITS, y.sum()
    q = len(y) - p
    a, b = np.zeros(size), np.zeros(size)
    for slots, toxic in zip(x, y, strict=True):  # a text has a slot once
        (a if toxic else b)[slots] += 1
    # Log odds ratio and its error, with half a text added to each cell.
    odds = np.log((a + 0.5) / (p - a + 0.5)) - np.log((b + 0.5) / (q - b + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (p - a + 0.5) + 1 / (b + 0.5) + 1 / (q - b + 0.5))
    return np.abs(odds) >= least * error


def fit(
    x: list[np.ndarray],
    y: np.ndarray,
    twins: list[np.ndarray | None],
    counterfactual: float = 1.0,
    l2: float = 1e-4,
    epochs: int = 150,
    rate: float = 0.2,
    evidence: float = 3.5,
) -> Model:
    """Full-batch Adagrad on weighted log loss plus the counterfactual and ridge penalties.

    Only slots with enough evidence get a weight: long texts hold many words of their own, by which
    a model could learn its training texts by heart.
    """
    size, n = 1 << BITS, len(y)
    if n == 0:
        return Model(np.zeros(size, np.float32), -500.0)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Model(np.zeros(size, np.float32), base)
    use = evident(x, y, evidence)
    row, slot = _ragged([s[use[s]] for s in x])
    pairs = [k for k, t in enumerate(twins) if t is not None]
    twin_row, twin_slot = _ragged([twins[k][use[twins[k]]] for k in pairs])
    at = np.array(pairs, np.int64)
    of_pair = np.full(n, -1, np.int64)
    of_pair[at] = np.arange(len(at))
    mine = of_pair[row] >= 0
    # The difference of a pair's log-odds is linear in the weights: +1 for own, -1 for twin slots.
    d_row = np.concatenate([of_pair[row[mine]], twin_row])
    d_slot = np.concatenate([slot[mine], twin_slot])
    d_sign = np.concatenate([np.ones(int(mine.sum())), -np.ones(len(twin_row))])
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / n
    w, bias = np.zeros(size), base
    seen, seen_bias = np.full(size, 1e-8), 1e-8
    for _ in range(epochs):
        z = np.bincount(row, w[slot], n) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(slot, error[row], size) + l2 * w
        if len(at):
            gap = np.bincount(d_row, d_sign * w[d_slot], len(at))
            grad += np.bincount(d_slot, (2 * counterfactual / len(at)) * gap[d_row] * d_sign, size)
        grad_bias = error.sum()
        seen += grad * grad
        seen_bias += grad_bias * grad_bias
        w -= rate * grad / np.sqrt(seen)
        bias -= rate * grad_bias / np.sqrt(seen_bias)
    return Model(w.astype(np.float32), bias)


def train(
    labelled: DataFrame,
    train_rows: int = TRAIN_ROWS,
    groups: Iterable[Iterable[str]] = IDENTITY_GROUPS,
    counterfactual: float = 1.0,
) -> Model:
    """Fit on at most ``train_rows`` rows of ``labelled`` (text, toxic)."""
    groups = tuple(map(tuple, groups))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        twins = [swapped(t, groups) for t in texts]
        kind = pa.list_(pa.int32())
        return pa.record_batch(
            [
                pa.array([features(t) for t in texts], kind),
                pa.array([None if t is None else features(t) for t in twins], kind),
                batch.column("toxic"),
                batch.column("key"),
            ],
            names=["own", "twin", "toxic", "key"],
        )

    rows = labelled.filter("text IS NOT NULL AND toxic IN (0, 1)").select(
        "text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("text").alias("key")
    )
    # The bound is met by a share of the hash range first, so that no text beyond it is moved.
    there = rows.count()
    share = min(1.0, 1.1 * train_rows / max(there, 1))
    if share < 1.0:
        rows = rows.filter(F.pmod("key", F.lit(1 << 20)) < int(share * (1 << 20)))
    got = (
        batches(rows, step, "own array<int>, twin array<int>, toxic int, key long")
        .orderBy("key", "toxic")
        .limit(train_rows)
        .toArrow()
    )
    x = [v.values.to_numpy() for v in got.column("own")]
    twins = [v.values.to_numpy() if v.is_valid else None for v in got.column("twin")]
    return fit(x, got.column("toxic").to_numpy().astype(np.float64), twins, counterfactual)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        scores = np.array([model.score(features(t.as_py())) for t in batch.column("text")], np.float64)
        return pa.record_batch(
            [batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
            names=["doc_id", "score", "predicted"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batches(docs.select("doc_id", "text"), step, f"doc_id {kind}, score double, predicted int")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns.

    Only texts go to Python and only scores come back; the rows stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: pa.Array) -> pa.Array:
        model = shared.value
        return pa.array([model.score(features(t.as_py())) for t in texts], pa.float64())

    return docs.filter(F.arrow_udf(scores, "double")("text") < threshold)
