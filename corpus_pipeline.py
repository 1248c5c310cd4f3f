"""A training corpus from raw documents: five stages, each on all that the one before kept.

Rejected toxic documents go, then exact copies, then near copies, then passages that an earlier
document has already; what remains is packed into sequences. All but the last stage return the
columns of ``documents``; ``n_chars`` is brought up to date where a text was shortened.

Every stage takes null ids and texts, repeated rows and extra columns as its operator defines them.
SQL cannot express the classifier, the band search or the packing, so there is no ``ORACLE_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.llm import exact, near, packing, passages, toxicity
from cartwise.llm.common import narrow, table
from cartwise.session import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the raw table and keeps what scores below the threshold."""
    labelled = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "text")
        .join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    )
    return toxicity.reject(docs, toxicity.train(labelled))


def _keep(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``dropped`` (doc_id)."""
    return narrow(docs, materialize(dropped.select("doc_id").distinct(), "dropped"), ["doc_id"], "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the ids are the snapshot, the others arrive; one row of each text stays."""
    found = exact.dedup(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    return _keep(docs, found.filter("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links of at least 80 % of the united five-word shingles; each component keeps its smallest id."""
    return _keep(docs, near.components_of(docs).filter("NOT kept"))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller id has already are cut out of the text."""
    out = passages.clean(docs, passages.find(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind)).select(*docs.columns)
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", cut_passages),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
