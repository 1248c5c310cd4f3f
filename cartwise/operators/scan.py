"""Ordered scans over groups and over whole tables that never need one big task.

``ordered_scan`` covers running sums, lag and whole-group aggregates of one key. Short groups
use an ordinary window. Where a group may be long it is cut into *blocks* that follow the sort
order: each block is scanned on its own, block summaries are scanned per key, and the summary of
everything before a block is added to its rows. Both ways give the same rows.

``global_rank`` numbers the rows of a whole table in sort order with the same idea, the blocks
being range partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.session import materialize

# Orders (or purchases) of one key that a single task may hold.
GROUP_ROWS = 1_000_000
# Positions per block once a key has more than that.
BLOCK_ROWS = 4_096
# Order ids per block among the orders of one key and day.
BLOCK_IDS = 1_000_000

_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def position_block(position: str, rows: int = BLOCK_ROWS) -> Column:
    """Block of a dense 1-based position: at most ``rows`` rows of a key share one."""
    return F.floor((F.col(position) - 1) / rows)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Sequence[Column],
    *,
    running: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    whole: Mapping[str, tuple[str, Column]] | None = None,
    split: bool = False,
) -> DataFrame:
    """Add running sums, lag-1 values and whole-group folds to ``df``.

    ``order`` must be unique within ``keys`` and ``block`` must not decrease along ``order``.
    """
    running, previous, whole = running or {}, previous or {}, whole or {}
    keys, order = list(keys), list(order)
    if not split:
        group = Window.partitionBy(*keys)
        ranked = group.orderBy(*order)
        upto = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns(
            {name: F.sum(value).over(upto) for name, value in running.items()}
            | {name: F.lag(value).over(ranked) for name, value in previous.items()}
            | {name: _FOLD[how](value).over(group) for name, (how, value) in whole.items()}
        )

    cuts = [f"__cut{i}" for i in range(len(block))]
    cut = df.withColumns(dict(zip(cuts, block)))
    newest = F.struct(*order)
    summary = cut.groupBy(*keys, *cuts).agg(
        F.count("*").alias("__rows"),
        *[F.sum(value).alias(f"__run_{name}") for name, value in running.items()],
        *[F.max_by(value, newest).alias(f"__last_{name}") for name, value in previous.items()],
        *[_FOLD[how](value).alias(f"__all_{name}") for name, (how, value) in whole.items()],
    )
    group = Window.partitionBy(*keys)
    along = group.orderBy(*cuts)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        *cuts,
        *[F.sum(f"__run_{name}").over(before).alias(f"__run_{name}") for name in running],
        *[F.lag(f"__last_{name}").over(along).alias(f"__last_{name}") for name in previous],
        *[_FOLD[how](f"__all_{name}").over(group).alias(name) for name, (how, _) in whole.items()],
    )
    inside = Window.partitionBy(*keys, *cuts).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns(
        {"__pos": F.row_number().over(inside)}
        | {f"__in_{name}": F.sum(value).over(upto) for name, value in running.items()}
        | {f"__lag_{name}": F.lag(value).over(inside) for name, value in previous.items()}
    )
    joined = local.join(carried, keys + cuts)
    return joined.select(
        *df.columns,
        *[
            F.when(F.col(f"__in_{name}").isNull(), F.col(f"__run_{name}"))
            .otherwise(F.col(f"__in_{name}") + F.coalesce(F.col(f"__run_{name}"), F.lit(0)))
            .alias(name)
            for name in running
        ],
        *[
            F.when(F.col("__pos") == 1, F.col(f"__last_{name}"))
            .otherwise(F.col(f"__lag_{name}"))
            .alias(name)
            for name in previous
        ],
        *whole,
    )


def global_rank(df: DataFrame, order: Sequence[str | Column], out: str = "rank", total: str | None = None) -> DataFrame:
    """Number all rows 1, 2, … along ``order`` (unique), optionally with the row total.

    Rows are range partitioned and numbered per partition. Only one row per partition (its size)
    is summed in one place and broadcast, so the bound on both is the partition count. The
    partitioned rows are stored first because range bounds are sampled anew on every run.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__rows"))
    everything = Window.orderBy("__part")
    starts = sizes.select(
        "__part",
        F.coalesce(
            F.sum("__rows").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__start"),
        F.sum("__rows").over(Window.partitionBy()).alias("__total"),
    )
    inside = Window.partitionBy("__part").orderBy(*order)
    ranked = ranged.withColumn("__pos", F.row_number().over(inside)).join(F.broadcast(starts), "__part")
    extra = [] if total is None else [F.col("__total").alias(total)]
    return ranked.select(*df.columns, (F.col("__start") + F.col("__pos")).alias(out), *extra)


def dense_ids(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Dictionary of the distinct values of ``columns`` with their dense rank."""
    return global_rank(df.select(*columns).distinct(), list(columns), out)


def ntile(rank: Column, total: Column, tiles: int) -> Column:
    """Tile of a 1-based rank among ``total`` rows; the first tiles take the remainder."""
    small = F.floor(total / tiles)
    large_rows = (total - small * tiles) * (small + 1)
    return F.when(
        rank <= large_rows, F.floor((rank - 1) / (small + 1)) + 1
    ).otherwise(
        (total - small * tiles) + F.floor((rank - 1 - large_rows) / F.greatest(small, F.lit(1))) + 1
    )
