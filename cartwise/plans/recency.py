"""Recency-ranked features per user, product, user-product, user-aisle and user-department.

Orders and purchases are ranked newest first. Purchases of one pair always carry the ranks
1 … n, so means, maxima and counts over those ranks follow from n and need no line-level window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.functions.columns import ratio
from cartwise.operators.joins import lookup_join
from cartwise.operators.scan import ordered_scan, position_block
from cartwise.operators.totals import grouping_totals
from cartwise.plans.candidates import known_label
from cartwise.plans.stats import count_if
from cartwise.session import materialize
from cartwise.sources.baskets import PRIOR, Baskets


CATEGORY_COLUMNS = ("aisle_id", "department_id")


def newest_first(rows: DataFrame, keys: list[str], out: str, split: bool = False) -> DataFrame:
    """Rank rows of each key by ``order_number`` (unique in the key), the newest being 1."""
    counted = ordered_scan(
        rows,
        keys,
        ["order_number"],
        [position_block("order_number")],
        running={"__nth": F.lit(1)},
        whole={"__all": ("sum", F.lit(1))},
        split=split,
    )
    return counted.withColumn(out, F.col("__all") - F.col("__nth") + 1).drop("__nth", "__all")


def ranked_orders(lines: DataFrame, split: bool = False) -> DataFrame:
    """Orders that have lines, ranked newest first per user, with their size and means."""
    per_order = lines.groupBy("user_id", "order_id", "order_number").agg(
        F.count("*").alias("bask_size"),
        F.sum("reordered").alias("reorders"),
        F.avg("order_dow").alias("order_dow"),
        F.avg("order_hour_of_day").alias("order_hour_of_day"),
        F.avg("days_since_prior_order").alias("days_since_prior_order"),
    )
    return newest_first(per_order, ["user_id"], "rank_order", split)


def product_recency_rank(prior: DataFrame) -> DataFrame:
    """Rank of a prior line among the purchases of its pair, the newest being 1."""
    return prior.withColumn("prod_rank_order", F.col("pair_prior_lines") - F.col("pair_nth") + 1)


def with_order_rank(lines: DataFrame, split: bool = False) -> DataFrame:
    """Lines with the newest-first rank of their order."""
    ranks = ranked_orders(lines, split).select("order_id", F.col("rank_order").alias("order_rank"))
    return lines.join(ranks, "order_id")


def pair_facts(b: Baskets, orders: DataFrame) -> DataFrame:
    """Additive facts per (user, product) from which all recency marts follow, and the label.

    ``orders`` comes from :func:`ranked_orders` over the prior lines.
    """
    prior = F.col("eval_set") == PRIOR

    def seen(c: Column) -> Column:
        return F.when(prior, c)

    days = F.col("days_since_prior_order")
    facts = (
        b.lines.groupBy("user_id", "product_id")
        .agg(
            F.count(seen(F.lit(1))).alias("n"),
            F.sum(seen(F.col("reordered"))).alias("again"),
            F.min(seen(F.col("order_number"))).alias("first"),
            F.max(seen(F.col("order_number"))).alias("newest"),
            F.sum(seen(F.col("add_to_cart_order"))).alias("position"),
            F.sum(seen(days)).alias("days"),
            F.count(seen(days)).alias("days_known"),
            count_if(prior & (F.col("order_number") > 1)).alias("later"),
            F.max((~prior).cast("int")).alias("reordered"),
        )
        .filter("n > 0")
    )
    ranks = orders.select(
        "user_id", F.col("order_number").alias("newest"), F.col("rank_order").alias("latest")
    )
    return facts.join(ranks, ["user_id", "newest"])


def _group_columns(suffix: str) -> dict[str, Column]:
    """Ten recency measures of a group of pairs, as aggregates."""
    n = F.sum("n")
    return {
        f"upor{suffix}": n,
        f"upro{suffix}": F.sum("again"),
        f"latest_or{suffix}": F.min("latest"),
        f"max_prod_ord{suffix}": F.max("n"),
        f"avg_prod_ord{suffix}": ratio(F.sum(F.col("n") * (F.col("n") + 1)), 2 * n),
        f"up_first_order{suffix}": F.min("first"),
        f"up_last_order{suffix}": F.max("newest"),
        f"up_average_cart_position{suffix}": ratio(F.sum("position"), n),
        f"up_order_rate{suffix}": n,
        f"upaog{suffix}": ratio(F.sum("days"), F.sum("days_known")),
    }


def _user_columns() -> dict[str, Column]:
    n, baskets = F.sum("n"), F.max("newest")
    return {
        "uror": ratio(F.sum("again"), F.sum("later")),
        "ul": n,
        "udl": F.count("*"),
        "num_baskets": baskets,
        "prod_ro_density": ratio(F.sum(F.col("n") * (F.col("n") + 1)), 2 * n),
        "avg_basket_size": ratio(n, baskets),
        "aog": ratio(F.sum("days"), F.sum("days_known")),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def pair_recency(facts: DataFrame) -> DataFrame:
    """Recency measures per (user, product); facts have one row each, so nothing is grouped."""
    n = F.col("n")
    measures = {
        "upor": n,
        "upro": F.col("again"),
        "latest_or": F.col("latest"),
        "max_prod_ord": n,
        "avg_prod_ord": (n + 1) / 2,
        "up_first_order": F.col("first"),
        "up_last_order": F.col("newest"),
        "up_average_cart_position": ratio("position", "n"),
        "up_order_rate": n,
        "upaog": ratio("days", "days_known"),
    }
    return facts.withColumns(measures)


def group_recency(facts: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    return facts.groupBy(*keys).agg(*_named(_group_columns(suffix)))


def basket_lags(orders: DataFrame) -> DataFrame:
    """Sizes of the two newest baskets per user, from :func:`ranked_orders`."""

    def size(rank: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("rank_order") == rank, F.col("bask_size"))), F.lit(0))

    return orders.groupBy("user_id").agg(size(1).alias("basket_size_lag"), size(2).alias("basket_size_lag1"))


def user_recency(facts: DataFrame, orders: DataFrame) -> DataFrame:
    """``facts`` from :func:`pair_facts`, ``orders`` from :func:`ranked_orders`."""
    return facts.groupBy("user_id").agg(*_named(_user_columns())).join(basket_lags(orders), "user_id")


def product_recency(facts: DataFrame) -> DataFrame:
    again = F.col("again") > 0
    repeat = count_if(F.col("n") >= 2)
    return facts.groupBy("product_id").agg(
        ratio(F.sum("again"), F.sum("n")).alias("pror"),
        F.sum("n").alias("pl"),
        ratio(count_if(again), F.count("*")).alias("pur"),
        F.sum("again").alias("prod_reorders"),
        F.count("*").alias("prod_last_orders"),
        repeat.alias("prod_secondlast_orders"),
        ratio(repeat, F.count("*")).alias("ror_prob"),
    )


def recency_mart(b: Baskets) -> DataFrame:
    """All recency features per (user, product) with the label of the target order.

    The pair facts are stored once; one aggregate over them gives the totals of the user, the user's aisles
    and the user's departments, which are joined back.
    """
    orders = materialize(ranked_orders(b.prior, b.split), "ranked")
    dims = b.products.select("product_id", "aisle_id", "department_id")
    facts = materialize(lookup_join(pair_facts(b, orders), dims, "product_id"), "facts")
    products = materialize(product_recency(facts), "products")
    flags = b.labelled_targets.select("user_id", F.col("eval_set").alias("flag"), "labelled")
    sets = [["user_id"], ["user_id", "aisle_id"], ["user_id", "department_id"]]
    user, aisle, department = grouping_totals(facts, sets, _user_columns() | _group_columns("_g"))
    mart = lookup_join(pair_recency(facts), user.select("user_id", *_user_columns()), "user_id")
    for totals, keys, suffix in ((aisle, sets[1], "_a"), (department, sets[2], "_d")):
        renamed = [F.col(f"{c}_g").alias(f"{c}{suffix}") for c in _group_columns("")]
        mart = lookup_join(mart, totals.select(*keys, *renamed), keys, null_safe=True)
    mart = mart.join(basket_lags(orders), "user_id").join(flags, "user_id")
    mart = lookup_join(mart, products, "product_id")
    baskets = F.col("num_baskets")
    derived = {}
    for tail, source in (("_p", ""), ("_a", "_a"), ("_d", "_d")):
        count, first, last = (F.col(f"{c}{source}") for c in ("upor", "up_first_order", "up_last_order"))
        share = "up_order_rate_p" if tail == "_p" else f"up_order_rate_share{tail}"
        derived[share] = ratio(count, baskets)
        derived[f"up_orders_since_last_order{tail}"] = baskets - last
        derived[f"up_order_rate_since_first_order{tail}"] = ratio(count, baskets - first + 1)
    mart = mart.withColumns(derived)
    filled = mart.fillna(0, subset=[c for c in mart.columns if c not in ("reordered", *CATEGORY_COLUMNS)])
    return filled.withColumn("reordered", known_label()).drop("labelled")
