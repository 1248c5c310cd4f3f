"""Time between purchases of the same product by the same user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.operators.scan import ordered_scan, position_block
from cartwise.plans.stats import with_medians

GAP_COLUMNS = ("last", "prev1", "prev2", "median", "mean", "sdev")


def order_timeline(orders: DataFrame, split: bool = False) -> DataFrame:
    """Days since the first order as the running sum of gaps; unknown gaps count zero."""
    return ordered_scan(
        orders,
        ["user_id"],
        ["order_number"],
        [position_block("order_number")],
        running={"days_since_prior_order_comsum": F.coalesce(F.col("days_since_prior_order"), F.lit(0))},
        split=split,
    )


def numbered_gaps(lines: DataFrame, with_target: bool = False) -> DataFrame:
    """Number the stored gaps of basket lines from the newest, which is 1, in ``gap_no``.

    Without the target order its line, the newest of the pair, gets number 0, which no measure
    reads.
    """
    newest = F.col("pair_lines" if with_target else "pair_prior_lines")
    return lines.withColumn("gap_no", F.when(F.col("gap").isNotNull(), newest - F.col("pair_nth") + 1))


def scanned_gaps(lines: DataFrame, split: bool = False, prefix: Sequence[str] = (), seen: Column | None = None) -> DataFrame:
    """Work out ``gap`` and ``gap_no`` where lines are grouped further (``prefix``).

    With ``seen`` only lines where it holds take part; the other lines get NULL in both. They
    must be newer than the lines taking part.
    """
    keep = F.lit(1) if seen is None else seen.cast("int")
    scanned = ordered_scan(
        lines,
        [*prefix, "user_id", "product_id"],
        ["order_number"],
        [position_block("order_number")],
        running={"__nth": keep},
        previous={"__before": F.col("timeline")},
        whole={"__all": ("sum", keep)},
        split=split,
    )
    gap = F.col("timeline") - F.col("__before")
    gap_no = F.when(F.col("__before").isNotNull(), F.col("__all") - F.col("__nth") + 1)
    if seen is not None:
        gap, gap_no = F.when(seen, gap), F.when(seen, gap_no)
    return scanned.withColumns({"gap": gap, "gap_no": gap_no}).drop("__nth", "__before", "__all")


def gap_measures() -> list[Column]:
    """Newest three gaps, and mean and deviation of all but the newest; gaps are whole days."""
    nth, gap = F.col("gap_no"), F.col("gap")
    older = F.when(nth >= 2, gap)
    return [
        F.max(F.when(nth == 1, gap)).alias("last"),
        F.max(F.when(nth == 2, gap)).alias("prev1"),
        F.max(F.when(nth == 3, gap)).alias("prev2"),
        _mean(older).alias("mean"),
        _deviation(older).alias("sdev"),
    ]


def _mean(days: Column) -> Column:
    return F.sum(days.cast("bigint")) / F.count(days)


def _deviation(days: Column) -> Column:
    """Population deviation of whole days from integer sums, alike in any order of the rows."""
    n, x = F.count(days), days.cast("bigint")
    spread = n * F.sum(x * x) - F.sum(x) * F.sum(x)
    return F.when(n > 0, F.sqrt(spread) / n)


def with_gap_medians(pairs: DataFrame, gapped: DataFrame, prefix: Sequence[str] = ()) -> DataFrame:
    """Add the median of all gaps but the newest; three such gaps take five lines."""
    older = gapped.filter(F.col("gap_no") >= 2)
    return with_medians(pairs, older, [*prefix, "user_id", "product_id"], {"gap": ("mean", "median")}, 5)


def purchase_gaps(lines: DataFrame, with_target: bool = False) -> DataFrame:
    return numbered_gaps(lines, with_target).filter(F.col("gap_no") >= 1)


def purchase_gap_stats(gapped: DataFrame, prefix: Sequence[str] = ()) -> DataFrame:
    """Gap statistics per (user, product) of lines with numbered gaps; pairs bought once have NULLs.

    Pass prior lines, or all lines numbered with the target to let it close the newest gap.
    """
    pairs = gapped.groupBy(*prefix, "user_id", "product_id").agg(*gap_measures())
    return with_gap_medians(pairs, gapped, prefix)
