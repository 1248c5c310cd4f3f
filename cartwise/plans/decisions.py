"""From scores to predicted baskets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.functions.expected_f1 import optimal_basket
from cartwise.plans import stats
from cartwise.plans.candidates import known_label
from cartwise.sources.baskets import PRIOR, Baskets

# Thresholds in use for turning a score into a prediction.
THRESHOLDS = (0.2, 0.205, 0.21, 0.22, 0.25, 0.5)
# Candidates of an order in the report of the best ones.
TOP_CANDIDATES = 80


def scored(b: Baskets) -> DataFrame:
    """Candidates with label and two repeatable scores: order rates of the pair."""
    prior = F.col("eval_set") == PRIOR
    pairs = (
        b.lines.groupBy("user_id", "product_id")
        .agg(F.max((~prior).cast("int")).alias("reordered"), *stats.user_product_measures(when=prior))
        .filter("up_orders > 0")
        .join(stats.user_stat(b.prior_orders).select("user_id", "user_orders"), "user_id")
    )
    target = b.labelled_targets.select("user_id", "order_id", "labelled")
    return stats.with_rates(pairs).join(target, "user_id").select(
        "order_id",
        "user_id",
        "product_id",
        known_label(),
        F.col("up_order_rate").alias("score"),
        F.col("up_orders_per_order_since_first").alias("score2"),
    )


def predict(rows: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return rows.withColumn("predicted", (F.col(score) > threshold).cast("int"))


def blend(first: DataFrame, second: DataFrame, weight: float = 0.5, keys: Sequence[str] = ("order_id", "product_id")) -> DataFrame:
    """Weighted mean of two score tables, matched by key."""
    one = first.select(*keys, F.col("score").alias("__a"))
    two = second.select(*keys, F.col("score").alias("__b"))
    return one.join(two, list(keys)).select(
        *keys, (weight * F.col("__a") + (1.0 - weight) * F.col("__b")).alias("score")
    )


def submission(predicted: DataFrame, orders: DataFrame) -> DataFrame:
    """Space-joined chosen products for each of ``orders``, 'None' where nothing is chosen.

    An order without any candidate, such as a user's first, gets its 'None' too.
    """
    chosen = F.array_sort(F.collect_list("product_id"))  # at most a catalogue
    picked = (
        predicted.filter("predicted = 1")
        .groupBy("order_id")
        .agg(F.array_join(chosen.cast("array<string>"), " ").alias("products"))
    )
    return (
        orders.select("order_id")
        .join(picked, "order_id", "left")
        .select("order_id", F.coalesce("products", F.lit("None")).alias("products"))
        .orderBy("order_id")
    )


def none_probability(rows: DataFrame) -> DataFrame:
    """Probability that no candidate of an order is bought."""
    return rows.groupBy("order_id").agg(F.product(1.0 - F.col("score")).alias("p_none"))


def with_none_candidate(rows: DataFrame) -> DataFrame:
    """Candidates and, for each order, product 0 for "None" with the chance that nothing is bought."""
    none = none_probability(rows).select("order_id", F.lit(0).cast("bigint").alias("product_id"), F.col("p_none").alias("score"))
    return rows.select("order_id", F.col("product_id").cast("bigint").alias("product_id"), "score").unionByName(none)


def top_candidates(rows: DataFrame, k: int = TOP_CANDIDATES) -> DataFrame:
    best = Window.partitionBy("order_id").orderBy(F.desc("score"), "product_id")
    return rows.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)


def score_rank(rows: DataFrame) -> DataFrame:
    best = Window.partitionBy("user_id").orderBy(F.desc("score"))
    return rows.withColumn("rank", F.dense_rank().over(best))


def optimal_k(rows: DataFrame, *, allow_none: bool = True, k: int | None = None) -> DataFrame:
    """Best basket size per order with its candidates, best first.

    Groups hold the candidates of one order, at most one per product of the catalogue; with ``k``
    only the best so many enter the search.
    """
    rows = rows if k is None else top_candidates(rows, k)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "product_id", "score")))
    groups = rows.groupBy("order_id").agg(ranked.alias("ranked"))
    best = groups.withColumn("best", optimal_basket(F.col("ranked.score"), allow_none=allow_none))
    return best.select(
        "order_id",
        F.col("ranked.product_id").alias("products"),
        F.col("best.k").alias("k_max"),
        F.col("best.pred_none").alias("pred_none"),
        F.col("best.ef1").alias("ef1"),
    )


def baskets(rows: DataFrame, *, allow_none: bool = True) -> DataFrame:
    """The best k products of every order as text, with 'None' first where it is predicted."""
    best = optimal_k(rows, allow_none=allow_none)
    picked = F.slice("products", F.lit(1), F.col("k_max").cast("int")).cast("array<string>")
    none = F.when(F.col("pred_none"), F.array(F.lit("None"))).otherwise(F.array().cast("array<string>"))
    return best.select(
        "order_id", "k_max", "pred_none", F.array_join(F.concat(none, picked), " ").alias("products")
    )
