"""Aggregates per product, user, user and product, user and category.

Most of them go through one row per (user, product): that grain is reached with a combining
aggregate, so neither a popular product nor a busy user puts its raw lines into one task, and
distinct counts above it become plain counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.functions.columns import ratio
from cartwise.operators.joins import lookup_join



def count_if(condition: Column) -> Column:
    return F.sum(condition.cast("int"))


def pairs(lines: DataFrame, prefix: Sequence[str] = ()) -> DataFrame:
    """One row per (user, product) with its line, reorder and cart position totals."""
    return lines.groupBy(*prefix, "user_id", "product_id").agg(
        F.count("*").alias("up_orders"),
        F.sum("reordered").alias("reordered_sum"),
        F.sum("add_to_cart_order").alias("position_sum"),
    )


def product_stat(up: DataFrame, prefix: Sequence[str] = ()) -> DataFrame:
    """Everything known about a product, from ``pairs`` rows."""
    ever = F.col("reordered_sum") > 0
    return up.groupBy(*prefix, "product_id").agg(
        F.sum("up_orders").alias("prod_orders"),
        F.sum("reordered_sum").alias("prod_reorders"),
        ratio(F.sum("position_sum"), F.sum("up_orders")).alias("prod_add_to_card_mean"),
        ratio(F.sum("reordered_sum"), F.sum("up_orders")).alias("reorder_ration"),
        F.avg(ever.cast("double")).alias("reorder_prob"),
        F.count("*").alias("prod_users_unq"),
        count_if(ever).alias("prod_users_unq_reordered"),
    )


def product_repeat_stat(up: DataFrame) -> DataFrame:
    """Reorder probability from the counts of first and second purchases.

    Purchases of a pair are numbered 1 … n, so first purchases are the pairs and second
    purchases the pairs with n of two or more: ``pairs`` rows are enough.
    """
    second = count_if(F.col("up_orders") >= 2)
    return up.groupBy("product_id").agg(
        F.sum("up_orders").alias("prod_orders"),
        ratio(second, F.count("*")).alias("prod_reorder_probability"),
        (1 + ratio(F.sum("reordered_sum"), F.count("*"))).alias("prod_reorder_times"),
        ratio(F.sum("reordered_sum"), F.sum("up_orders")).alias("prod_reorder_ratio"),
    )


def user_stat(prior_orders: DataFrame, prefix: Sequence[str] = ()) -> DataFrame:
    gap = F.col("days_since_prior_order")
    return prior_orders.groupBy(*prefix, "user_id").agg(
        F.max("order_number").alias("user_orders"),
        F.sum(F.coalesce(gap, F.lit(0))).alias("user_order_starts_at"),
        F.avg(gap).alias("user_mean_days_since_prior"),
        F.median(gap).alias("user_median_days_since_prior"),
    )


def user_basket_stat(
    up: DataFrame, users: DataFrame, prefix: Sequence[str] = (), users_prefix: Sequence[str] | None = None
) -> DataFrame:
    """Basket totals per user, from ``pairs`` rows and ``user_stat``.

    ``users_prefix`` names the leading keys of ``users`` where they differ from ``prefix``.
    """
    on = [*(prefix if users_prefix is None else users_prefix), "user_id"]
    totals = up.groupBy(*prefix, "user_id").agg(
        F.sum("up_orders").alias("user_total_products"),
        ratio(F.sum("reordered_sum"), F.sum("up_orders")).alias("user_reorder_ratio"),
        F.count("*").alias("user_distinct_products"),
    )
    return totals.join(users, on).withColumn(
        "user_average_basket", ratio("user_total_products", "user_orders")
    )


def user_reorder_ratio(prior: DataFrame) -> DataFrame:
    """Share of reorders among lines outside the first order."""
    return prior.groupBy("user_id").agg(
        ratio(F.sum("reordered"), count_if(F.col("order_number") > 1)).alias("user_reorder_ratio")
    )


def with_cart_features(lines: DataFrame) -> DataFrame:
    """Distance from the end of the cart and relative position."""
    return lines.withColumns(
        {
            "add_to_cart_order_inverted": F.col("order_size") - F.col("add_to_cart_order"),
            "add_to_cart_order_relative": ratio("add_to_cart_order", "order_size"),
        }
    )


# Line columns whose mean and median enter the user-product statistics.
SPREAD = {
    "add_to_cart_order": ("up_mean_cart_position", "up_median_cart_position"),
    "days_since_prior_order": ("days_since_prior_order_mean", "days_since_prior_order_median"),
    "order_dow": ("order_dow_mean", "order_dow_median"),
    "order_hour_of_day": ("order_hour_of_day_mean", "order_hour_of_day_median"),
    "add_to_cart_order_inverted": ("add_to_cart_order_inverted_mean", "add_to_cart_order_inverted_median"),
    "add_to_cart_order_relative": ("add_to_cart_order_relative_mean", "add_to_cart_order_relative_median"),
}


def user_product_measures(spread: Sequence[str] = (), when: Column | None = None) -> list[Column]:
    """Aggregates of a user-product group, optionally over the lines where ``when`` holds."""

    def seen(c: Column) -> Column:
        return c if when is None else F.when(when, c)

    orders, again = F.count(seen(F.lit(1))), F.sum(seen(F.col("reordered")))
    return [
        orders.alias("up_orders"),
        F.min(seen(F.col("order_number"))).alias("up_first_order"),
        F.max(seen(F.col("order_number"))).alias("up_last_order"),
        again.alias("reordered_sum"),
        ratio(again + 1, orders).alias("user_product_reordered_ratio"),
        F.sum(seen(F.col("add_to_cart_order"))).alias("position_sum"),
        *[F.avg(seen(F.col(column))).alias(SPREAD[column][0]) for column in spread],
    ]


def with_medians(
    means: DataFrame, lines: DataFrame, keys: Sequence[str], columns: dict[str, tuple[str, str]], lines_needed: int = 3
) -> DataFrame:
    """Add exact medians to ``means``; ``columns`` maps a line column to its (mean, median) names.

    Up to two values their median is their mean, so only pairs with ``lines_needed`` lines or more
    enter the median aggregate. It keeps a counter per distinct value: days, hours and cart
    positions have few, hence even a pair with very many lines combines before the shuffle.
    """
    medians = (
        lines.filter(F.col("pair_lines") >= lines_needed)
        .groupBy(*keys)
        .agg(*[F.median(column).alias(f"__{median}") for column, (_, median) in columns.items()])
    )
    joined = means.join(medians, list(keys), "left")
    return joined.withColumns(
        {median: F.coalesce(f"__{median}", mean) for mean, median in columns.values()}
    ).drop(*[f"__{median}" for _, median in columns.values()])


def user_product_stat(prior: DataFrame, prefix: Sequence[str] = (), spread: Sequence[str] = tuple(SPREAD)) -> DataFrame:
    """All measures per (user, product)."""
    lines = with_cart_features(prior) if "add_to_cart_order_relative" in spread else prior
    keys = [*prefix, "user_id", "product_id"]
    means = lines.groupBy(*keys).agg(*user_product_measures(spread))
    return with_medians(means, lines, keys, {c: SPREAD[c] for c in spread}) if spread else means


def with_rates(up: DataFrame) -> DataFrame:
    """Order rates of a pair; needs ``user_orders`` on the row."""
    since_first = F.col("user_orders") - F.col("up_first_order") + 1
    return up.withColumns(
        {
            "up_order_rate": ratio("up_orders", "user_orders"),
            "up_orders_since_last_order": F.col("user_orders") - F.col("up_last_order"),
            "up_order_rate_since_first_order": ratio(F.col("user_orders"), since_first),
            "up_orders_per_order_since_first": ratio(F.col("up_orders"), since_first),
        }
    )


def up_rates(prior: DataFrame, prior_orders: DataFrame) -> DataFrame:
    up = user_product_stat(prior, spread=())
    return with_rates(up.join(user_stat(prior_orders), "user_id"))


def category_stat(up: DataFrame, products: DataFrame, category: str, label: str) -> DataFrame:
    """Distinct products and reorders per user and product category, from ``pairs`` rows."""
    keyed = lookup_join(up, products.select("product_id", category), "product_id")
    return keyed.groupBy("user_id", category).agg(
        F.count("*").alias(f"{label}_products"), F.sum("reordered_sum").alias(f"{label}_reordered")
    )


def last_order(prior: DataFrame) -> DataFrame:
    """Newest order of each pair with its number and hour."""
    newest = F.struct("order_number", "order_id")
    return prior.groupBy("user_id", "product_id").agg(
        F.count("*").alias("nb_orders"),
        F.sum("add_to_cart_order").alias("sum_pos_in_cart"),
        F.max_by(F.struct("order_id", "order_number", "order_hour_of_day"), newest).alias("newest"),
    ).select(
        "user_id",
        "product_id",
        "nb_orders",
        "sum_pos_in_cart",
        F.col("newest.order_id").alias("last_order_id"),
        F.col("newest.order_number").alias("last_order_number"),
        F.col("newest.order_hour_of_day").alias("last_order_hour"),
    )
