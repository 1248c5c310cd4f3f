"""Session helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A private folder is made only for a ``local`` master, where driver and executors are one
    process; on a cluster a missing setting is an error, since lost executors could not be
    recovered from a machine-local path.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="cartwise-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder for a written intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step", file_rows: int = 0) -> DataFrame:
    """Compute once, write to the shared folder and continue from the written table.

    The table survives lost executors, cuts the lineage, and is read back column by column with
    known size, which lets later joins choose their strategy. With ``file_rows`` a file holds at most so many rows,
    of which readers make tasks of equal size however uneven the parts of ``df`` are.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucketed(spark: SparkSession, path: str, ddl: str, keys: list[str], buckets: int) -> DataFrame:
    """The bucketed files at ``path`` under a name of this session's catalogue."""
    name = f"cartwise_{uuid.uuid4().hex}"
    by = ", ".join(keys)
    spark.sql(
        f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS "
        f"LOCATION '{path}'"
    )
    return spark.table(name)


def materialize_bucketed(
    df: DataFrame, name: str, keys: list[str], path: str | None = None, buckets: int | None = None
) -> DataFrame:
    """Like :func:`materialize`, with rows of equal ``keys`` in one sorted bucket.

    Aggregates and windows by these keys then read their buckets without a shuffle. Unless told otherwise there are
    as many buckets as shuffle partitions, so rows that come from a shuffle by the keys are written where they are. The files
    need no catalogue: :func:`open_bucketed` finds them again in another session.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name) if path is None else path
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    table = f"cartwise_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def open_bucketed(spark: SparkSession, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Files written by :func:`materialize_bucketed` with so many buckets."""
    fields = spark.read.parquet(path).schema.fields
    return _bucketed(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), keys, buckets)
