"""Products a target order may repeat, with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.sources.baskets import PRIOR, Baskets

TARGET_COLUMNS = ("order_number", "order_dow", "order_hour_of_day", "days_since_prior_order")


def previous_products(prior: DataFrame) -> DataFrame:
    return prior.select("user_id", "product_id").distinct()


def candidates(b: Baskets) -> DataFrame:
    """Every product of a user's history against that user's target order.

    A user has one target order and at most the whole catalogue as candidates.
    """
    target = b.target_orders.select("user_id", "order_id", "eval_set")
    return previous_products(b.prior).join(target, "user_id")


def bought_before_and_now(lines: DataFrame) -> DataFrame:
    """Pairs of the history with the flag whether the target order holds them, in one pass.

    A user's lines outside the history all belong to that user's target order, so the label
    needs no join: both facts come from one aggregate over the pair.
    """
    prior = F.col("eval_set") == PRIOR
    return (
        lines.groupBy("user_id", "product_id")
        .agg(F.max(prior.cast("int")).alias("before"), F.max((~prior).cast("int")).alias("reordered"))
        .filter("before = 1")
        .drop("before")
    )


def known_label(label: str = "reordered") -> Column:
    """The label, or NULL where the target order's lines are not known (see ``Baskets.labelled_targets``)."""
    return F.when(F.col("labelled"), F.col(label)).alias(label)


def candidate_labels(b: Baskets) -> DataFrame:
    target = b.labelled_targets.select("user_id", "order_id", "eval_set", "labelled")
    labels = bought_before_and_now(b.lines).join(target, "user_id")
    return labels.withColumn("reordered", known_label()).drop("labelled")


def label_join(candidate: DataFrame, truth: DataFrame) -> DataFrame:
    """Left join form for labels from elsewhere: (order_id, product_id) pairs that happened."""
    found = truth.select("order_id", "product_id").distinct().withColumn("reordered", F.lit(1))
    return candidate.join(found, ["order_id", "product_id"], "left").fillna({"reordered": 0})
