"""Runs of words that repeat with a period, such as a menu or a line pasted again and again.

A *run* is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal),
at least ``max(least, 2 * q)`` words long, that no neighbouring word extends with that period.

**Splitting.** Every word of a run recurs ``q`` words away inside it, so a word that occurs once in
a segment belongs to none of its runs, and no run goes across it. Such words split their segment,
counting starts again in each part, and parts shorter than ``least`` are left out, until nothing
changes. All segments of a text are counted together in each round. Ordinary prose is gone after
one or two rounds.

**Lag scan.** In what survives, a run of period ``q`` is a stretch of at least ``max(least - q, q)``
places whose word equals the word ``q`` places on. Lags below ``DIRECT`` are compared place by
place. A longer lag in ``[2 * b, 4 * b)``, with ``b`` a power of two, has a stretch that holds an
aligned block of ``b`` words; blocks are named by doubling (two places get the same number exactly
if their ``b`` words are equal), so the lags to look at are the distances to other places of the
same name, at most two per word and class, and stretches are measured by descending through the
names. Work is in proportion to ``n * log(n)`` words in place of ``n * n / 2``. A stretch found
before with a smaller lag is the same run; its period is the smaller one.

Texts are handled one by one, whole, in Arrow batches; nothing is shuffled. Defined cases: a null or
empty text has no runs and collapses to the empty text. Rows that repeat an id each give a row, null
ids too. Words are compared byte by byte, upper and lower case apart. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import WORD_RULE, batches, texts_of

LEAST = 12
#: Lags below this are compared place by place.
DIRECT = 32
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as small numbers, equal exactly for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _parts(at: np.ndarray) -> np.ndarray:
    """Segment number of each of the ascending places ``at``; neighbours share one."""
    return np.cumsum(np.diff(at, prepend=at[:1] - 2) != 1) - 1


def segments(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the stretches that splitting at words occurring once leaves over."""
    at = np.arange(len(ids))
    while len(at) >= least:
        part = _parts(at)
        long = np.bincount(part)[part] >= least
        _, group, count = np.unique(part * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        kept = at[long & (count[group] >= 2)]
        if len(kept) == len(at):
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            return [(int(a[0]), int(a[-1]) + 1) for a in np.split(at, edges[1:])]
        at = kept
    return []


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of stretches of true places at least ``least`` long."""
    edges = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    return [(int(a), int(b)) for a, b in edges if b - a >= least]


def block_names(ids: np.ndarray) -> list[np.ndarray]:
    """Level ``j``: a number for the ``2**j`` words from each place, equal exactly for equal words."""
    names, width = [ids], 1
    while 2 * width <= len(ids):
        last = names[-1]
        pairs = last[:-width] * (int(last.max()) + 1) + last[width:]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return names


def _same(names: np.ndarray, here: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Where both places lie inside and have the same name."""
    inside = (here >= 0) & (here + lag < len(names))
    safe = np.where(inside, here, 0)
    return inside & (names[safe] == names[np.where(inside, here + lag, 0)])


def _far_lags(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(lag, start, end) of maximal stretches at lags from ``DIRECT`` on that are as long as their lag."""
    n, names, found = len(ids), block_names(ids), []
    level = DIRECT.bit_length() - 2
    while 2 * (2 << level) <= n:
        block, name = 1 << level, names[level]
        keys = np.sort(name * n + np.arange(len(name)))
        anchor = np.arange(0, len(name), block)
        low = np.searchsorted(keys, name[anchor] * n + np.minimum(anchor + 2 * block, n))
        high = np.searchsorted(keys, name[anchor] * n + np.minimum(anchor + 4 * block, n))
        times = high - low
        left = np.repeat(anchor, times)
        nth = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        lag = keys[np.repeat(low, times) + nth] % n - left
        right = left + block
        for j in range(len(names) - 1, -1, -1):
            right = right + (_same(names[j], right, lag) << j)
            left = left - (_same(names[j], left - (1 << j), lag) << j)
        fit = right - left >= lag
        found += np.unique(np.stack([lag, left, right], axis=1)[fit], axis=0).tolist()
        level += 1
    return found


def lag_scan(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a segment, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, min(DIRECT - 1, len(ids) // 2) + 1):
        for a, b in _stretches(ids[:-lag] == ids[lag:], max(least - lag, lag)):
            found.setdefault((a, b + lag), lag)
    if len(ids) >= 2 * DIRECT:
        for lag, a, b in sorted(_far_lags(ids)):
            if b - a + lag >= least:
                found.setdefault((a, b + lag), lag)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    if len(words) < least:
        return []
    ids = numbered(words)
    return [(a + s, n, q) for a, b in segments(ids, least) for s, n, q in lag_scan(ids[a:b], least)]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: each run keeps its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed): all runs of each text, and its kept words joined by one space.

    ``runs`` holds structs (start, length, period) by start, then period; places are word numbers from 0.
    """
    if least < 2:
        raise ValueError("a run has at least two words")
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, left = [], []
        for text in texts_of(batch):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            found = runs_of(words, least)
            runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
            left.append(b" ".join(collapse(words, found)).decode("utf-8", "surrogatepass"))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(runs, pa.list_(RUN)), pa.array(left, pa.string())],
            names=["doc_id", "runs", "collapsed"],
        )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return batches(rows, step, schema)


def longest(runs: str | Column) -> Column:
    """The run with the greatest length; of several the one with the smallest start, then period."""
    run = F.col(runs) if isinstance(runs, str) else runs
    ordered = F.transform(run, lambda r: F.struct(r.length, -r.start, -r.period, r.alias("run")))
    return F.array_max(ordered)["run"]


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """``text`` with a made run in about a tenth of the documents, chosen by the crc32 ``h`` of the id.

    With ``n`` words, ``g = h / 10``, ``a = g % n`` and ``p = 1 + (n - a) / (3 + g % 8)`` (whole
    quotients), word ``i`` from ``a`` on becomes word ``a + (i - a) % p``. Null ids are left alone.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD_RULE})"), 1)
    n = F.size(words)
    a = F.pmod(g, n.cast("long")).cast("int")
    p = (F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int")
    # Word by word lookups would cut the text anew for each word; whole slices do it a fixed number of times.
    copies = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
    made = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(copies), F.lit(1), n - a))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(made, " ")).otherwise(F.col(text))
