"""Language identification by words first, then by ever shorter character n-grams.

Training counts the words of every labelled text per language, and the 1- to 5-grams of those words
(with a blank at both ends). A word or n-gram is *known* for a language when its share of that
language's words or n-grams reaches ``least_share`` and it occurs at least ``least_count`` times;
shares of a language add up to one, so at most ``1 / least_share`` entries per language and kind can
be known, whatever the size of the corpus. That proven bound is what is sent to the executors.

A known word costs the negative log frequency in each language, or ``penalty`` where the language
does not know it. Any other word costs the mean over its longest n-grams of which at least one is
known. The language with the smallest mean cost per word wins, a tie goes to the smaller name.
The score is a softmax of the costs, in (0, 1].

Defined cases: a null text or one without a letter gives ``und`` and score 0, as does every text when
nothing could be learned. Repeated rows each give a row. Extra columns are ignored. Rows without a
text or language teach nothing. Texts are used whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.llm.common import batches
from cartwise.session import materialize

LEAST_SHARE, LEAST_COUNT, LONGEST = 5e-6, 2, 5
UNDETERMINED = "und"
_RUNS = re.compile(r"[^\W\d_]+")
_FLUSH, _CACHE = 300_000, 400_000


def letter_runs(text: str | None) -> list[str]:
    """Lower-case words of letters."""
    if not text:
        return []
    found = _RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combine counts before the shuffle; memory is bounded by ``_FLUSH`` words per language."""
    counts: dict[str, Counter] = {}

    def out(lang: str, counter: Counter) -> pa.RecordBatch:
        n = len(counter)
        return pa.record_batch(
            [pa.array([lang] * n), pa.array(list(counter)), pa.array(list(counter.values()), pa.int64())],
            names=["lang", "word", "n"],
        )

    for batch in it:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            counter = counts.setdefault(lang, Counter())
            counter.update(letter_runs(text.as_py()))
            if len(counter) > _FLUSH:
                yield out(lang, counter)
                counter.clear()
    for lang, counter in counts.items():
        if counter:
            yield out(lang, counter)


def _count_grams(longest: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}

        def out() -> pa.RecordBatch:
            langs, sizes, keys = zip(*counts, strict=True)
            return pa.record_batch(
                [pa.array(langs), pa.array(sizes, pa.int32()), pa.array(keys), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "size", "gram", "n"],
            )

        for batch in it:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                for size in range(1, longest + 1):
                    for g in grams(word, size):
                        key = (lang, size, g)
                        counts[key] = counts.get(key, 0) + n
                if len(counts) > _FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return run


@dataclass
class Model:
    """Cost per language of every known word and n-gram."""

    languages: list[str]
    words: dict[str, int]
    word_cost: np.ndarray
    grams: dict[str, int]
    gram_cost: np.ndarray
    longest: int = LONGEST

    def unseen(self, word: str) -> np.ndarray:
        for n in range(min(self.longest, len(word) + 2), 0, -1):
            rows = [r for g in grams(word, n) if (r := self.grams.get(g)) is not None]
            if rows:
                return self.gram_cost[rows].mean(axis=0)
        return np.full(len(self.languages), self.word_cost.max(initial=1.0), np.float32)


def _table(rows: list, languages: list[str], totals: dict, penalty: float) -> tuple[dict[str, int], np.ndarray]:
    at: dict[str, int] = {}
    for r in rows:
        at.setdefault(r[0], len(at))
    cost = np.full((len(at), len(languages)), penalty, np.float32)
    column = {lang: k for k, lang in enumerate(languages)}
    for key, lang, n, total in ((r[0], r[1], r[2], totals[r[3]]) for r in rows):
        cost[at[key], column[lang]] = -math.log10(n / total)
    return at, cost


def _known(counts: DataFrame, by: list[str], totals: dict, least_share: float, least_count: int) -> Column:
    """Entries that reach the share of their language's total; at most ``1 / least_share`` of each."""
    reached = F.lit(False)
    for key, total in totals.items():
        same = F.lit(True)
        for name, value in zip(by, key if isinstance(key, tuple) else (key,), strict=True):
            same &= F.col(name) == value
        reached |= same & (F.col("n") >= max(least_count, math.ceil(least_share * total)))
    return reached


def train(
    docs: DataFrame, least_share: float = LEAST_SHARE, least_count: int = LEAST_COUNT, longest: int = LONGEST
) -> Model:
    """Learn from all rows of ``docs`` (lang, text) that have both."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counted = materialize(
        rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "language-words",
    )
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    penalty = -math.log10(least_share) + 1
    known_words = [
        (r["word"], r["lang"], r["n"], r["lang"])
        for r in counted.filter(_known(counted, ["lang"], totals, least_share, least_count)).collect()
    ]
    parts = materialize(
        counted.mapInArrow(_count_grams(longest), "lang string, size int, gram string, n long")
        .groupBy("lang", "size", "gram")
        .agg(F.sum("n").alias("n")),
        "language-grams",
    )
    sums = {(r["lang"], r["size"]): r["n"] for r in parts.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    known_grams = [
        (r["gram"], r["lang"], r["n"], (r["lang"], r["size"]))
        for r in parts.filter(_known(parts, ["lang", "size"], sums, least_share, least_count)).collect()
    ]
    words, word_cost = _table(known_words, languages, totals, penalty)
    gram_rows, gram_cost = _table(known_grams, languages, sums, penalty)
    return Model(languages, words, word_cost, gram_rows, gram_cost, longest)


class _Costs(dict):
    """Row of each word in one growing cost matrix; unseen words are added on first sight."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.base = model, len(model.words)
        self.matrix = np.empty((self.base + 4096, len(model.languages)), np.float32)
        self.matrix[: self.base] = model.word_cost

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row >= len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
        self.matrix[row] = self.model.unseen(word)
        self[word] = row
        return row

    def trim(self) -> None:
        """Forget added words when there are too many; between texts only."""
        if len(self) > self.base + _CACHE:
            self.clear()
            self.update(self.model.words)


_COSTS: dict[int, _Costs] = {}


def _costs(broadcast) -> _Costs:
    if broadcast.id not in _COSTS:
        _COSTS.clear()
        _COSTS[broadcast.id] = _Costs(broadcast.value)
    return _COSTS[broadcast.id]


class _Shared:
    """A broadcast with a key that workers can remember it by."""

    def __init__(self, spark: SparkSession, value):
        self.cast = spark.sparkContext.broadcast(value)
        self.id = self.cast._jbroadcast.id()

    def __getstate__(self):
        return {"cast": self.cast, "id": self.id}

    @property
    def value(self):
        return self.cast.value


def predict_text(costs: _Costs, text: str | None) -> tuple[str, float]:
    model = costs.model
    found = letter_runs(text)
    if not found or not model.languages:
        return UNDETERMINED, 0.0
    costs.trim()
    counter = Counter(found)
    rows = np.fromiter(map(costs.__getitem__, counter), np.int64, len(counter))
    weights = np.fromiter(counter.values(), np.float64, len(counter))
    total = weights @ costs.matrix[rows].astype(np.float64)
    best = int(total.argmin())
    # Words of a text are far from independent: evidence counts with the root of their number.
    gap = (total - total[best]) * (math.log(10) / math.sqrt(len(found)))
    return model.languages[best], float(1.0 / np.exp(-gap).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text)."""
    shared = _Shared(docs.sparkSession, model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        costs = _costs(shared)
        out = [predict_text(costs, t.as_py()) for t in batch.column("text")]
        langs, scores = zip(*out, strict=True) if out else ((), ())
        return pa.record_batch(
            [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
            names=["doc_id", "lang_pred", "score"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batches(docs.select("doc_id", "text"), step, f"doc_id {kind}, lang_pred string, score double")
