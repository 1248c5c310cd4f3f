"""Exact document dedup against immutable snapshots that carry static filters.

A snapshot is a written table of text groups plus one binary fuse filter per digest bucket. A new
batch is grouped on its own first (duplicates inside the batch are found there). Its group digests
go to their bucket's filter; what the filter rejects is new. What it lets through joins the
snapshot's groups of that bucket. Finally the texts of all groups with more than one row are
compared byte by byte: rows that share a digest must share one text.

Texts are equal when they agree after all six ASCII white-space characters are deleted. Null texts
count as empty, empty texts equal each other. Of equal texts the row with the most code points in
the original stays, then the smallest id; a null id comes last. Repeated rows are rows of their own.
Extra columns are ignored.

Hot groups: digests are counted with a combining aggregate, so a group of any size is one row per
task when it is shuffled; joins back to rows may be split by AQE, since nothing needs a group's rows
together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm import fuse
from cartwise.session import materialize

#: Digests of a filter on average; buckets are a power of two, at least ``LEAST_BUCKETS``.
BUCKET_KEYS, LEAST_BUCKETS = 65_536, 64
_DELETED = " \t\n\x0b\x0c\r"


def squeezed(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(c.cast("string"), F.lit("")), _DELETED, "")


def digests(docs: DataFrame, earlier: Column | None = None) -> DataFrame:
    """(doc_id, early, digest, text_sha256, points): what is known of a row without its text."""
    early = F.lit(False) if earlier is None else F.coalesce(earlier, F.lit(False))
    return docs.select(
        "doc_id",
        early.alias("early"),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("points"),
        squeezed("text").alias("__t"),
    ).select(
        "doc_id", "early", "points", F.xxhash64("__t").alias("digest"), F.sha2("__t", 256).alias("text_sha256")
    )


def _best() -> Column:
    """Longest original text first, then the smallest id, a null id last."""
    return F.min(F.struct((-F.col("points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id")))


def group(rows: DataFrame) -> DataFrame:
    """One row per distinct text: its best row and how many rows it has."""
    return rows.groupBy("digest", "text_sha256").agg(F.count("*").alias("n"), _best().alias("best"))


@dataclass(frozen=True)
class Snapshot:
    """Immutable groups of an earlier state, their filters, and the number of bucket bits."""

    groups: DataFrame
    filters: DataFrame
    bits: int


def _bucket(bits: int) -> Column:
    return F.shiftrightunsigned("digest", 64 - bits).alias("bucket")


def build_snapshot(rows: DataFrame) -> Snapshot:
    """Group ``rows`` (of ``digests``), write the groups, and build a filter for each bucket."""
    groups = materialize(group(rows), "snapshot-groups")
    keys = groups.count()
    bits = max(LEAST_BUCKETS, 1 << max(0, (keys // BUCKET_KEYS)).bit_length()).bit_length() - 1

    def one(part: pd.DataFrame) -> pd.DataFrame:
        blob = fuse.build(part["digest"].to_numpy().view(np.uint64))
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "filter": [blob]})

    filters = (
        groups.select(_bucket(bits), "digest").groupBy("bucket").applyInPandas(one, "bucket long, filter binary")
    )
    return Snapshot(groups, materialize(filters, "snapshot-filters"), bits)


def screen(batch_groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(digest, text_sha256) of the batch groups that a snapshot's filters let through."""

    def pick(part: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(filters) or not len(part):
            return part[["digest", "text_sha256"]].iloc[:0]
        hit = fuse.contains(filters["filter"].iloc[0], part["digest"].to_numpy().view(np.uint64))
        return part.loc[hit, ["digest", "text_sha256"]]

    keyed = batch_groups.select(_bucket(snapshot.bits), "digest", "text_sha256")
    return (
        keyed.groupBy("bucket")
        .cogroup(snapshot.filters.groupBy("bucket"))
        .applyInPandas(pick, "digest long, text_sha256 string")
    )


def merge(snapshot: Snapshot, batch_groups: DataFrame) -> DataFrame:
    """Groups of snapshot and batch together: only screened groups meet the exact buckets."""
    both = ["digest", "text_sha256"]
    hits = materialize(screen(batch_groups, snapshot), "screened")
    known = snapshot.groups.join(hits, both, "left_semi")
    united = (
        snapshot.groups.join(hits, both, "left_anti")
        .unionByName(batch_groups.join(hits, both, "left_anti"))
        .unionByName(
            known.unionByName(batch_groups.join(hits, both, "left_semi"))
            .groupBy(*both)
            .agg(F.sum("n").alias("n"), F.min("best").alias("best"))
        )
    )
    return united


def byte_check(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(digest, text_sha256, texts) for groups of several rows: how many different texts each holds."""
    repeated = groups.filter("n > 1").select("digest")
    texts = docs.select(squeezed("text").alias("__t")).select("__t", F.xxhash64("__t").alias("digest"))
    return (
        texts.join(repeated, "digest", "left_semi")
        .groupBy("digest", "__t")
        .agg(F.lit(1).alias("one"))
        .groupBy("digest", F.sha2("__t", 256).alias("text_sha256"))
        .agg(F.count("*").alias("texts"))
    )


def dedup(docs: DataFrame, earlier: Column) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): which row of its text stays.

    ``earlier`` marks the rows of the immutable snapshot; the others are the incoming batch. Columns:
    doc_id, keep_id, group_size, kept, text_sha256. A byte check that finds two texts under one key
    fails the job.
    """
    rows = materialize(digests(docs, earlier), "digests")
    snapshot = build_snapshot(rows.filter("early"))
    batch_groups = materialize(group(rows.filter("NOT early")), "batch-groups")
    groups = materialize(merge(snapshot, batch_groups), "groups")
    checked = byte_check(docs, groups)
    several = F.col("n") > 1
    verdict = groups.join(checked, ["digest", "text_sha256"], "left").select(
        "digest",
        "text_sha256",
        "n",
        "best",
        F.when(several & ~F.coalesce(F.col("texts") == 1, F.lit(False)), F.raise_error("texts differ under one key"))
        .otherwise(F.lit(True))
        .cast("boolean")
        .alias("same"),
    )
    return (
        rows.join(verdict, ["digest", "text_sha256"])
        .filter("same")
        .select(
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            F.coalesce(F.col("doc_id") == F.col("best.doc_id"), F.col("doc_id").isNull() & F.col("best.doc_id").isNull())
            .alias("kept"),
            "text_sha256",
        )
    )
