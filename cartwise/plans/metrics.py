"""Quality measures of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.functions.columns import fbeta, log_loss_term, ratio
from cartwise.plans.stats import count_if


def _counts(truth: Column, guess: Column) -> list[Column]:
    return [
        count_if((truth == 1) & (guess == 1)).alias("tp"),
        count_if((truth == 0) & (guess == 1)).alias("fp"),
        count_if((truth == 1) & (guess == 0)).alias("fn"),
    ]


def fbeta_table(predicted: DataFrame, betas: Sequence[float] = (0.5, 1.0, 2.0)) -> DataFrame:
    """F-beta over all rows, one row per beta."""
    counts = predicted.agg(*_counts(F.col("reordered"), F.col("predicted")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scores = F.array(*[F.struct(F.lit(b).alias("beta"), fbeta(tp, fp, fn, b).alias("f")) for b in betas])
    return counts.select("tp", "fp", "fn", F.explode(scores).alias("s")).select("tp", "fp", "fn", "s.beta", "s.f")


def mean_f1(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """F1 per order, averaged over orders, for each threshold; undefined F1 counts zero.

    All thresholds share one pass and one shuffle by order.
    """
    truth = F.col("reordered")
    per_order = rows.groupBy("order_id").agg(
        count_if(truth == 1).alias("true"),
        *[count_if(F.col("score") > t).alias(f"said_{i}") for i, t in enumerate(thresholds)],
        *[count_if((F.col("score") > t) & (truth == 1)).alias(f"hit_{i}") for i, t in enumerate(thresholds)],
    )

    def f1(i: int) -> Column:
        return F.coalesce(ratio(2 * F.col(f"hit_{i}"), F.col("true") + F.col(f"said_{i}")), F.lit(0.0))

    means = per_order.agg(*[F.avg(f1(i)).alias(f"f_{i}") for i in range(len(thresholds))])
    table = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.col(f"f_{i}").alias("mean_f1")) for i, t in enumerate(thresholds)]
    )
    return means.select(F.explode(table).alias("r")).select("r.threshold", "r.mean_f1")


def class_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F and support of both classes."""
    cells = predicted.agg(
        *_counts(F.col("reordered"), F.col("predicted")),
        count_if((F.col("reordered") == 0) & (F.col("predicted") == 0)).alias("tn"),
    )

    def row(label: int, hit: str, wrong: str, missed: str) -> Column:
        hit, wrong, missed = F.col(hit), F.col(wrong), F.col(missed)
        return F.struct(
            F.lit(label).alias("label"),
            F.coalesce(ratio(hit, hit + wrong), F.lit(0.0)).alias("precision"),
            F.coalesce(ratio(hit, hit + missed), F.lit(0.0)).alias("recall"),
            F.coalesce(ratio(2 * hit, 2 * hit + wrong + missed), F.lit(0.0)).alias("fscore"),
            (hit + missed).alias("support"),
        )

    rows = F.array(row(0, "tn", "fn", "fp"), row(1, "tp", "fp", "fn"))
    return cells.select(F.inline(rows))


def log_loss(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(log_loss_term(F.col("reordered"), F.col("score"))).alias("log_loss"))


def mape(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    error = ratio(F.abs(F.col(actual) - F.col(predicted)), F.col(actual)) * 100
    return rows.agg(F.avg(error).alias("mape"))


def _masked_mean(rows: DataFrame, y: str, y_hat: str, length: str, term) -> Column:
    """Sum of ``term(y, ŷ)`` over the first ``length`` steps of all rows, per step.

    Arrays are folded inside their row; only the sums leave it.
    """
    n = F.greatest(F.col(length), F.lit(0))
    steps = F.arrays_zip(
        F.slice(F.col(y), F.lit(1), n).alias("y"), F.slice(F.col(y_hat), F.lit(1), n).alias("p")
    )
    folded = F.aggregate(steps, F.lit(0.0), lambda total, s: total + term(s.y, s.p))
    return ratio(F.sum(folded), F.sum(n))


def sequence_log_loss(rows: DataFrame, y: str, y_hat: str, length: str) -> DataFrame:
    return rows.agg(_masked_mean(rows, y, y_hat, length, log_loss_term).alias("sequence_log_loss"))


def sequence_rmse(rows: DataFrame, y: str, y_hat: str, length: str) -> DataFrame:
    def squared(a: Column, b: Column) -> Column:
        return (a - b) * (a - b)

    return rows.agg(F.sqrt(_masked_mean(rows, y, y_hat, length, squared)).alias("sequence_rmse"))
