"""Shared pieces: reading tables, folds, bounded word caches and batch loops."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Entries after which a worker's cache is emptied; it bounds memory and never changes a result.
CACHE_ENTRIES = 200_000
#: The six characters that separate words or are deleted for exact comparison.
SPACES = " \t\n\x0b\x0c\r"
#: ASCII-only lower case of bytes; other letters keep their case.
_LOWER = bytes(c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))
WORD_RULE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` is called so."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def row_keys(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(doc_id, text) with ids that tell texts apart, and the way back to the ids of ``docs``.

    Ids that are neither null nor repeated stay as they are. Otherwise an id becomes a text that sorts
    like it (null last), then the MD5 of the row's text; equal rows share one. The way back maps
    ``doc_id`` and ``first_doc`` and adds ``text_id``, that MD5, or null where ids are enough.
    """
    plain = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    if plain.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return plain, lambda found: found.withColumn("text_id", F.lit(None).cast("string"))
    whole = isinstance(kind, IntegralType)
    shift = F.lit("9223372036854775808").cast("decimal(20,0)")
    own = F.col("doc_id")
    name = F.lpad((own.cast("decimal(20,0)") + shift).cast("string"), 20, "0") if whole else own.cast("string")
    none = "~" if whole else "\U0010ffff"
    key = F.concat(F.coalesce(name, F.lit(none)), F.lit("\x01"), F.coalesce(F.md5("text"), F.lit("")))

    def back(column: str) -> Column:
        id_ = F.regexp_extract(column, "(?s)^(.*)\x01[0-9a-f]*$", 1)
        value = (id_.cast("decimal(20,0)") - shift).cast(kind) if whole else id_.cast(kind)
        return F.when(id_ != none, value)

    def restore(found: DataFrame) -> DataFrame:
        text_id = F.regexp_extract("doc_id", "\x01([0-9a-f]*)$", 1)
        return found.withColumns(
            {"text_id": text_id, **{c: back(c) for c in ("doc_id", "first_doc") if c in found.columns}}
        )

    return plain.withColumn("doc_id", key).dropDuplicates(["doc_id"]), restore


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id falls into the fold of ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def words(text: str) -> list[str]:
    """Lower-case A-Z, then the runs without the six spaces.

    Both are properties of single bytes of UTF-8, where ``bytes`` methods do just this.
    """
    runs = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return b"\n".join(runs).decode("utf-8", "surrogatepass").split("\n") if runs else []


class WordHash(dict):
    """64-bit hashes of words, remembered per worker up to ``CACHE_ENTRIES`` words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


_WORD_HASH = WordHash()


def word_hashes(text: str | None) -> np.ndarray:
    return _WORD_HASH.of(words(text)) if text else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text is one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    w = min(width, n)
    out = np.zeros(n - w + 1, np.uint64)
    for k in range(w):
        out = mix(out + hashes[k : n - w + 1 + k] + np.uint64(k + 1))
    return np.unique(out)


def batches(
    rows: DataFrame, step: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Run ``step`` on every Arrow batch of ``rows``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = step(batch)
            if out is None:
                continue
            yield from [out] if isinstance(out, pa.RecordBatch) else out

    return rows.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()


#: Keys of at most this many rows of one or two longs (about 40 bytes each once hashed) are broadcast.
BROADCAST_KEYS = 3_000_000


def at_ids(docs: DataFrame, places: DataFrame, entries: int) -> DataFrame:
    """Texts of ``docs`` with the row of ``places`` (at_id, ...) for their id; null ids match too.

    ``places`` is a stored table that holds ``entries`` small entries in all. Few are broadcast, so
    that only the wanted texts move on; more take an ordinary join with the same rows.
    """
    if entries <= BROADCAST_KEYS // 3:
        places = F.broadcast(places)
    return docs.select("doc_id", "text").join(places, F.col("doc_id").eqNullSafe(F.col("at_id")))


def narrow(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Join ``rows`` with a stored table of distinct keys.

    The keys are counted. Few enough to send to every task spare a shuffle of wide rows; more of
    them take an ordinary join, which AQE may split. Both give the same rows.
    """
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return rows.join(keys, on, how)
