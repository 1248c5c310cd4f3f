"""MinHash near-dedup of documents with sequential Bayesian verification.

Texts become sets of word shingles. Documents with equal sets form a class; one signature stands for
the class. Classes that share a band are candidates. Their signatures are compared batch by batch:
after each batch the posterior of the similarity (uniform prior, binomial matches) says how likely it
still reaches the threshold, and the pair is dropped once that chance is below ``MISS``. What
survives is verified on the full sets. Verified links make components.

Chances: a pair at the threshold shares no band with a chance of ``(1 - t**ROWS)**BANDS`` (7e-6 at
0.8), and is wrongly pruned with a chance of at most ``MISS`` per batch.

Defined cases: null and empty texts, and texts of white space alone, have empty sets and are linked
with nothing. A text with fewer words than a shingle is one shingle. Repeated rows and equal sets are
one class, so they are linked. Null ids lose every tie. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import at_ids, batches, shingles, word_hashes
from cartwise.llm.linking import link, shared_buckets
from cartwise.llm.minhash import MinHash
from cartwise.session import materialize

WIDTH, PERCENT, ROWS, BANDS, MISS, BATCH = 5, 80, 5, 30, 1e-6, 30


@lru_cache(maxsize=4)
def _minhash(bands: int, rows: int) -> MinHash:
    return MinHash(bands, rows)


def class_of(values: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    h = xxhash.xxh3_64_intdigest(values.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def features(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, cls, bands, sig): ``sig`` is the low byte of every minimum."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        family = _minhash(bands, rows)
        sizes, names, keys, sigs = [], [], [], []
        for text in batch.column("text"):
            values = shingles(word_hashes(text.as_py()), width)
            sizes.append(len(values))
            names.append(class_of(values))
            if len(values):
                signature = family.signature(values)
                keys.append(family.band_keys(signature))
                sigs.append((signature & np.uint32(255)).astype(np.uint8).tobytes())
            else:
                keys.append(np.empty(0, np.int64))
                sigs.append(b"")
        return pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(names, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(sigs, pa.binary()),
            ],
            names=["doc_id", "n_shingles", "cls", "bands", "sig"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batches(
        docs.select("doc_id", "text"), step, f"doc_id {kind}, n_shingles long, cls long, bands array<long>, sig binary"
    )


@lru_cache(maxsize=8)
def least_matches(hashes: int, batch: int, threshold: float, missed: float) -> tuple[tuple[int, int], ...]:
    """(hashes seen, fewest matches to go on) after every batch.

    A hash of one byte matches with chance ``s + (1 - s) / 256``. The posterior of ``s`` under a
    uniform prior is integrated on a grid.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    high = s >= threshold
    out = []
    for n in range(batch, hashes + 1, batch):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            mass = np.exp(log - log.max())
            if mass[high].sum() >= missed * mass.sum():
                break
        out.append((n, m))
    return tuple(out)


def bayes_screen(sigs: DataFrame, hashes: int, percent: int, missed: float = MISS, batch: int = BATCH):
    """Screen for ``link``: joins both signatures to a pair and compares them batch by batch."""
    steps = least_matches(hashes, batch, percent / 100, missed)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in it:
            if not part.num_rows:
                continue
            p = np.frombuffer(b"".join(part.column("p").to_pylist()), np.uint8).reshape(-1, hashes)
            q = np.frombuffer(b"".join(part.column("q").to_pylist()), np.uint8).reshape(-1, hashes)
            alive, matches, seen = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), 0
            for upto, fewest in steps:
                matches[alive] += (p[alive, seen:upto] == q[alive, seen:upto]).sum(axis=1)
                alive, seen = alive[matches[alive] >= fewest], upto
            if len(alive):
                kept = part.take(pa.array(alive)).drop_columns(["p", "q"])
                yield kept.append_column("matches", pa.array(matches[alive], pa.int64()))

    def screen(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(sigs.select(F.col("cls").alias("a"), F.col("sig").alias("p")), "a").join(
            sigs.select(F.col("cls").alias("b"), F.col("sig").alias("q")), "b"
        )
        order = [c for c in ("item", "a", "b") if c in pairs.columns]
        return joined.select(*order, "p", "q").mapInArrow(run, ", ".join(f"{c} long" for c in order) + ", matches long")

    return screen


def bayes_compare(hashes: int, percent: int, missed: float = MISS, batch: int = BATCH):
    """The same inside a cell of two blocks of signatures."""
    steps = least_matches(hashes, batch, percent / 100, missed)

    def compare(first: list, second: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        p = np.frombuffer(b"".join(first), np.uint8).reshape(-1, hashes)
        q = np.frombuffer(b"".join(second), np.uint8).reshape(-1, hashes)
        alive, matches, seen = np.arange(len(i)), np.zeros(len(i), np.int64), 0
        for upto, fewest in steps:
            matches[alive] += (p[i[alive], seen:upto] == q[j[alive], seen:upto]).sum(axis=1)
            alive, seen = alive[matches[alive] >= fewest], upto
        keep = np.zeros(len(i), bool)
        keep[alive] = True
        return keep

    return compare


def _bodies(docs: DataFrame, classes: DataFrame, buckets: DataFrame, width: int) -> DataFrame:
    """(cls, body): one whole text for each class that has a candidate."""
    wanted = materialize(
        classes.join(buckets.select("cls").distinct(), "cls", "left_semi").select(
            F.col("least").alias("at_id"), F.col("cls").alias("want")
        ),
        "wanted-classes",
    )

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        # An id may have several texts: only the one that makes this class counts.
        same = [
            class_of(shingles(word_hashes(t.as_py()), width)) == w
            for t, w in zip(batch.column("body"), batch.column("cls").to_pylist(), strict=True)
        ]
        return batch.filter(pa.array(same, pa.bool_()))

    rows = at_ids(docs, wanted, wanted.count())
    return batches(
        rows.select(F.col("want").alias("cls"), F.col("text").alias("body")), step, "cls long, body string"
    ).dropDuplicates(["cls"])


def components_of(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id that can be reached over links, ``kept`` whether it is the
    row's own.
    """
    known = materialize(features(docs, width), "features")
    classes = materialize(
        known.filter("n_shingles > 0")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sig").alias("sig")),
        "classes",
    )
    buckets = shared_buckets(classes)
    bodies = materialize(_bodies(docs, classes, buckets, width), "bodies")
    involved = classes.join(buckets.select("cls").distinct(), "cls", "left_semi").select("cls", "sig", "bands")
    parts = link(
        buckets,
        bodies,
        lambda text: shingles(word_hashes(text), width),
        percent,
        bayes_screen(involved, BANDS * ROWS, percent),
        involved,
        bayes_compare(BANDS * ROWS, percent),
    )
    named = parts.withColumnRenamed("id", "cls").join(classes.select("cls", "least"), "cls")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = named.join(smallest, "component").select("cls", "component_id")
    target = materialize(
        classes.select("cls", "least")
        .join(moved, "cls", "left")
        .select("cls", F.coalesce("component_id", "least").alias("component_id")),
        "class-components",
    )
    return (
        known.select("doc_id", "n_shingles", "cls")
        .join(target, "cls", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
