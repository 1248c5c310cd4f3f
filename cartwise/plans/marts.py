"""Feature marts: one row per candidate, user or order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.functions.columns import circular_hours, mean_of_known, ratio
from cartwise.operators.joins import lookup_join
from cartwise.operators.scan import global_rank, ntile
from cartwise.operators.totals import grouping_totals
from cartwise.plans import gaps, stats
from cartwise.plans.candidates import TARGET_COLUMNS, known_label
from cartwise.plans.recency import ranked_orders
from cartwise.session import materialize
from cartwise.sources.baskets import PRIOR, Baskets
from cartwise.sources.files import embedding_columns

# Value put for purchase gaps that do not exist.
MISSING_GAP = 9999
# Value put for all other missing numbers of a snapshot.
MISSING = 999
# Share of customers, the last by rank, that is held out.
HOLDOUT_SHARE = 0.1

FEATURES = [
    "user_product_reordered_ratio", "reordered_sum",
    "add_to_cart_order_inverted_mean", "add_to_cart_order_relative_mean",
    "reorder_prob",
    "last", "prev1", "prev2", "median", "mean",
    "dep_reordered_ratio", "aisle_reordered_ratio",
    "aisle_products", "aisle_reordered", "dep_products", "dep_reordered",
    "prod_users_unq", "prod_users_unq_reordered",
    "order_number", "prod_add_to_card_mean", "days_since_prior_order", "order_dow", "order_hour_of_day",
    "reorder_ration",
    "user_orders", "user_order_starts_at", "user_mean_days_since_prior",
    "user_average_basket", "user_distinct_products", "user_reorder_ratio", "user_total_products",
    "prod_orders", "prod_reorders",
    "up_order_rate", "up_orders_since_last_order", "up_order_rate_since_first_order",
    "up_orders", "up_first_order", "up_last_order", "up_mean_cart_position",
    "days_since_prior_order_mean", "order_dow_mean", "order_hour_of_day_mean",
]
CATEGORIES = ["product_id", "aisle_id", "department_id"]


def pair_mart(b: Baskets, spread: Sequence[str], medians: bool = False) -> DataFrame:
    """History measures, gap statistics and label of every pair, in one aggregate over the lines.

    Lines of the target order only set the label.
    """
    prior = F.col("eval_set") == PRIOR
    gapped = gaps.numbered_gaps(stats.with_cart_features(b.lines))
    pairs = (
        gapped.groupBy("user_id", "product_id")
        .agg(
            F.max((~prior).cast("int")).alias("reordered"),
            *stats.user_product_measures(spread, when=prior),
            *gaps.gap_measures(),
        )
        .filter("up_orders > 0")
    )
    pairs = gaps.with_gap_medians(pairs, gapped)
    if medians:
        columns = {c: stats.SPREAD[c] for c in spread}
        pairs = stats.with_medians(pairs, b.prior, ["user_id", "product_id"], columns)
    return pairs


def _category(column: str) -> Column:
    """Key of a category; products without one form one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_user_totals(pairs: DataFrame) -> DataFrame:
    """Totals per user, per user and department, per user and aisle on every pair."""
    sets = [["user_id"], ["user_id", "department_id"], ["user_id", "aisle_id"]]
    measures = {"lines": F.sum("up_orders"), "again": F.sum("reordered_sum"), "products": F.count("*")}
    user, department, aisle = grouping_totals(pairs, sets, measures)
    user = user.select(
        "user_id",
        F.col("lines").alias("user_total_products"),
        F.col("products").alias("user_distinct_products"),
        ratio("again", "lines").alias("user_reorder_ratio"),
    )
    # A user has at most a catalogue of categories, so one row per user carries them all and the pairs are moved once.
    users = user
    for totals, keys, name in ((department, sets[1], "dep"), (aisle, sets[2], "aisle")):
        each = F.struct(
            _category(keys[1]),
            F.struct(F.col("products").alias(f"{name}_products"), F.col("again").alias(f"{name}_reordered")),
        )
        of = totals.groupBy("user_id").agg(F.map_from_entries(F.collect_list(each)).alias(f"__{name}"))
        users = users.join(of, "user_id")
    return (
        lookup_join(pairs, users, "user_id")
        .withColumn("__dep", F.col("__dep")[_category("department_id")])
        .withColumn("__aisle", F.col("__aisle")[_category("aisle_id")])
        .select(*pairs.columns, *[c for c in user.columns if c != "user_id"], "__dep.*", "__aisle.*")
    )


def training_mart(b: Baskets) -> DataFrame:
    """All features per (target order, candidate product) with the label ``reordered``."""
    pairs = lookup_join(
        pair_mart(b, tuple(stats.SPREAD)), b.products.select("product_id", "aisle_id", "department_id"), "product_id"
    )
    pairs = materialize(pairs)
    products = materialize(stats.product_stat(pairs))
    target = b.labelled_targets.select("user_id", "order_id", "eval_set", "labelled", *TARGET_COLUMNS)
    mart = (
        with_user_totals(pairs)
        .join(stats.user_stat(b.prior_orders), "user_id")
        .join(target, "user_id")
        .withColumn("user_average_basket", ratio("user_total_products", "user_orders"))
        .withColumn("dep_reordered_ratio", ratio("dep_reordered", "user_orders"))
        .withColumn("aisle_reordered_ratio", ratio("aisle_reordered", "user_orders"))
    )
    mart = lookup_join(stats.with_rates(mart), products, "product_id")
    return mart.fillna(MISSING_GAP, subset=list(gaps.GAP_COLUMNS)).select(
        "order_id", "user_id", "eval_set", *CATEGORIES, *FEATURES, known_label()
    )


def with_embeddings(mart: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Attach the 32 embedding columns to products that have a vector."""
    return lookup_join(mart, embedding_columns(embeddings), "product_id")


LGBM_FEATURES = [
    "user_total_orders", "user_total_items", "total_distinct_items",
    "user_average_days_between_orders", "user_average_basket",
    "order_hour_of_day", "days_since_prior_order", "days_since_ratio",
    "aisle_id", "department_id", "product_orders", "product_reorders", "product_reorder_rate",
    "UP_orders", "UP_orders_ratio", "UP_average_pos_in_cart", "UP_reorder_rate",
    "UP_orders_since_last", "UP_delta_hour_vs_last",
]


def lgbm_features(b: Baskets) -> DataFrame:
    """Compact mart over all orders of a user, with the clock distance to the last purchase."""
    prior = F.col("eval_set") == PRIOR
    seen = F.struct("order_number", "order_hour_of_day")
    pairs = (
        b.lines.groupBy("user_id", "product_id")
        .agg(
            F.max((~prior).cast("int")).alias("label"),
            F.sum(prior.cast("int")).alias("up_orders"),
            F.sum(F.when(prior, F.col("reordered"))).alias("reordered_sum"),
            F.sum(F.when(prior, F.col("add_to_cart_order"))).alias("position_sum"),
            F.max(F.when(prior, seen)).alias("newest"),
        )
        .filter("up_orders > 0")
    )
    pairs = lookup_join(pairs, b.products.select("product_id", "aisle_id", "department_id"), "product_id")
    pairs = materialize(pairs)
    products = materialize(
        stats.product_stat(pairs).select(
            "product_id",
            F.col("prod_orders").alias("product_orders"),
            F.col("prod_reorders").alias("product_reorders"),
            F.col("reorder_ration").alias("product_reorder_rate"),
        )
    )
    users = b.orders.groupBy("user_id").agg(
        F.count("*").alias("user_total_orders"),
        F.avg("days_since_prior_order").alias("user_average_days_between_orders"),
    )
    items = pairs.groupBy("user_id").agg(
        F.sum("up_orders").alias("user_total_items"), F.count("*").alias("total_distinct_items")
    )
    target = b.labelled_targets.select(
        "user_id", "order_id", "eval_set", "labelled", "order_hour_of_day", "days_since_prior_order"
    )
    mart = lookup_join(
        pairs.join(items, "user_id").join(users, "user_id").join(target, "user_id"), products, "product_id"
    )
    total = F.col("user_total_orders")
    share = ratio(F.col("up_orders"), total)
    return mart.select(
        "order_id",
        "user_id",
        "product_id",
        "eval_set",
        known_label("label"),
        total,
        "user_total_items",
        "total_distinct_items",
        "user_average_days_between_orders",
        ratio(F.col("user_total_items"), total).alias("user_average_basket"),
        "order_hour_of_day",
        "days_since_prior_order",
        ratio("days_since_prior_order", "user_average_days_between_orders").alias("days_since_ratio"),
        "aisle_id",
        "department_id",
        "product_orders",
        "product_reorders",
        "product_reorder_rate",
        F.col("up_orders").alias("UP_orders"),
        share.alias("UP_orders_ratio"),
        ratio("position_sum", "up_orders").alias("UP_average_pos_in_cart"),
        share.alias("UP_reorder_rate"),
        (total - F.col("newest.order_number")).alias("UP_orders_since_last"),
        circular_hours(F.col("order_hour_of_day"), F.col("newest.order_hour_of_day")).alias("UP_delta_hour_vs_last"),
    )


def compact_mart(b: Baskets) -> DataFrame:
    """Pair rates, user totals, product repeat statistics and the label."""
    prior = F.col("eval_set") == PRIOR
    later = prior & (F.col("order_number") > 1)
    pairs = materialize(
        b.lines.groupBy("user_id", "product_id")
        .agg(
            F.max((~prior).cast("int")).alias("reordered"),
            *stats.user_product_measures(when=prior),
            F.sum(later.cast("int")).alias("later_lines"),
        )
        .filter("up_orders > 0")
    )
    products = materialize(stats.product_repeat_stat(pairs))
    totals = pairs.groupBy("user_id").agg(
        F.sum("up_orders").alias("user_total_products"),
        ratio(F.sum("reordered_sum"), F.sum("later_lines")).alias("user_reorder_ratio"),
        F.count("*").alias("user_distinct_products"),
    )
    users = (
        stats.user_stat(b.prior_orders)
        .withColumnRenamed("user_order_starts_at", "user_period")
        .drop("user_median_days_since_prior")
    )
    target = b.labelled_targets.select(
        "user_id", "order_id", "eval_set", "labelled", F.col("days_since_prior_order").alias("time_since_last_order")
    )
    mart = pairs.join(totals, "user_id").join(users, "user_id").join(target, "user_id")
    mart = mart.withColumns(
        {
            "user_average_basket": ratio("user_total_products", "user_orders"),
            "up_average_cart_position": ratio("position_sum", "up_orders"),
            "reordered": known_label(),
        }
    ).drop("labelled")
    return lookup_join(stats.with_rates(mart), products, "product_id")


def user_segments(prior: DataFrame) -> DataFrame:
    """Deciles of users by reorder rate (ties by user id) and the segment of each decile."""
    users = prior.groupBy("user_id").agg(
        ratio(F.sum("reordered"), F.count("*")).alias("reorder_rate"), F.count("*").alias("lengt")
    )
    ranked = global_rank(users, ["reorder_rate", "user_id"], "__rank", "__total")
    tiled = ranked.withColumn("dec", ntile(F.col("__rank"), F.col("__total"), 10))
    return tiled.selectExpr(
        "user_id",
        "reorder_rate",
        "lengt",
        "dec",
        "CASE WHEN dec IN (1, 2) THEN 'Segment1' WHEN dec IN (3, 4, 5) THEN 'Segment2' "
        "WHEN dec IN (6, 7, 8) THEN 'Segment3' ELSE 'Segment4' END AS Segment",
    )


def order_profile(b: Baskets) -> DataFrame:
    """Per user and order rank (newest first): basket size, reorder rate, means, segment."""
    orders = ranked_orders(b.prior, b.split).withColumn("order_rate", ratio("reorders", "bask_size"))
    segments = user_segments(b.prior).select(
        "user_id", F.col("reorder_rate").alias("rate"), "lengt", F.col("Segment")
    )
    flags = b.target_orders.select("user_id", F.initcap("eval_set").alias("Flag"))
    return (
        lookup_join(orders, materialize(segments.join(flags, "user_id"), "segments"), "user_id")
        .withColumnRenamed("order_rate", "reorder_rate")
        .drop("reorders")
    )


def basket_size_mart(profile: DataFrame) -> DataFrame:
    """History, lag and target basket sizes per user in one aggregate instead of self-joins.

    Two rows per user: ``train`` explains the newest basket by the ones before it, ``score``
    describes all baskets. Only users held for scoring take part.
    """
    held = profile.filter(F.col("Flag") == "Test")
    kinds = F.explode(F.array(F.lit("train"), F.lit("score"))).alias("part")
    both = held.select("*", kinds)
    # The row of a basket within its part: the newest history basket is 1.
    back = F.col("rank_order") - F.when(F.col("part") == "train", 1).otherwise(0)
    history = back >= 1

    def past(c: str):
        return F.when(history, F.col(c))

    def lag(k: int):
        return F.max(F.when(back == k, F.col("bask_size")))

    mart = both.groupBy("user_id", "part").agg(
        lag(1).alias("bask_size_lag"),
        lag(2).alias("bask_size_lag1"),
        lag(3).alias("bask_size_lag2"),
        F.avg(past("bask_size")).alias("avg_b"),
        F.max(past("bask_size")).alias("max_b"),
        F.min(past("bask_size")).alias("min_b"),
        F.median(past("bask_size")).alias("mode_b"),
        F.max("Segment").alias("Segment"),
        F.max(past("rank_order")).alias("num_orders"),
        *[
            F.avg(past(c)).alias(c)
            for c in ("reorder_rate", "order_dow", "order_hour_of_day", "days_since_prior_order", "rate", "lengt")
        ],
        F.max(F.when((F.col("part") == "train") & (F.col("rank_order") == 1), F.col("bask_size"))).alias("dep"),
    )
    lags = mean_of_known(*[F.col(c) for c in ("bask_size_lag", "bask_size_lag1", "bask_size_lag2")])
    return (
        mart.filter(F.col("num_orders").isNotNull())
        .withColumn("avg_bask_lag", lags)
        .fillna(0, subset=["bask_size_lag2"])
    )


def with_holdout(ranks: DataFrame, share: float = HOLDOUT_SHARE) -> DataFrame:
    """Mark the last ``share`` of the ranks as ``test``, the others as ``train``."""
    total = ranks.agg(F.max("rank_cust").alias("total")).scalar()
    held = F.col("rank_cust") > F.ceil(total * (1 - share))
    return ranks.withColumn("part", F.when(held, "test").otherwise("train"))


def customer_ranks(orders: DataFrame) -> DataFrame:
    """Dense rank of customers by id."""
    return global_rank(orders.select("user_id").distinct(), ["user_id"], "rank_cust")


def snapshot_mart(b: Baskets) -> DataFrame:
    """One snapshot: features of the whole history, label from the newest order.

    Missing numbers become 999; each row carries its customer rank and the holdout part.
    """
    pairs = materialize(pair_mart(b, ("days_since_prior_order", "order_dow"), medians=True))
    products = materialize(stats.product_stat(pairs))
    users = stats.user_basket_stat(pairs, stats.user_stat(b.prior_orders))
    mart = lookup_join(stats.with_rates(pairs.join(users, "user_id")), products, "product_id")
    mart = mart.fillna(MISSING, subset=[c for c in mart.columns if c != "reordered"])
    mart = mart.join(b.labelled_targets.select("user_id", "labelled"), "user_id")
    ranks = with_holdout(customer_ranks(b.orders))
    return mart.withColumn("reordered", known_label()).drop("labelled").join(ranks, "user_id")


