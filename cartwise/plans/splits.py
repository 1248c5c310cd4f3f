"""Keys, folds, samples and unified logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.functions.columns import id_bucket, ratio
from cartwise.operators.joins import lookup_join
from cartwise.operators.scan import global_rank, ordered_scan, position_block
from cartwise.sources.baskets import Baskets


# Least number of product ids that an integer key leaves room for.
PRODUCT_ROOM = 100_000


def composite_keys(rows: DataFrame) -> DataFrame:
    """Text key of user and order, integer key of user and product.

    The user's part is a multiple of a power of ten above the largest product id, so keys never collide.
    """
    largest = rows.agg(F.coalesce(F.max("product_id"), F.lit(0)).alias("largest")).scalar()
    digits = F.length(F.greatest(largest, F.lit(PRODUCT_ROOM - 1)).cast("string"))
    room = F.rpad(F.lit("1"), digits + 1, F.lit("0")).cast("bigint")
    return rows.withColumns(
        {
            "user_order": F.concat_ws("_", "user_id", "order_number"),
            "user_product": F.col("product_id") + F.col("user_id") * room,
        }
    )


def hash_split(rows: DataFrame, column: str, percent: int = 75) -> DataFrame:
    """Repeatable train / validation mark per row from the bucket of an integer id."""
    return rows.withColumn("in_train", (id_bucket(F.col(column)) < percent).cast("int"))


def order_folds(orders: DataFrame, folds: int, keep_remainder: bool = True) -> DataFrame:
    """Contiguous folds of equal size over the sorted order ids; the last takes the remainder.

    Without ``keep_remainder`` those orders are in no fold. Fewer orders than folds leave folds empty.
    """
    ranked = global_rank(orders.select("order_id").distinct(), ["order_id"], "__rank", "__total")
    size = F.greatest(F.floor(F.col("__total") / folds), F.lit(1))
    fold = F.floor((F.col("__rank") - 1) / size)
    placed = ranked.withColumn("fold", F.least(fold, F.lit(folds - 1)) if keep_remainder else fold)
    return placed.filter(F.col("fold") < folds).select("order_id", "fold")


def fold_members(labels: DataFrame, folds: DataFrame) -> DataFrame:
    """Candidate rows whose order is in one of the folds."""
    return labels.join(folds.select("order_id"), "order_id", "left_semi")


def unified_transactions(b: Baskets) -> DataFrame:
    """All orders with their lines and a source flag; orders to score have -1 in place of lines.

    Flags: P prior, T train, D to be scored. An order without lines keeps a row without product.
    """
    source = F.when(F.col("eval_set") == "prior", "P").otherwise("T")
    known = b.lines.filter(F.col("eval_set") != "test").select(
        "order_id", "product_id", "add_to_cart_order", "reordered", source.alias("Flag")
    )
    scored = b.orders.filter(F.col("eval_set") == "test").select("order_id", F.lit("D").alias("Flag"))
    lines = known.unionByName(scored, allowMissingColumns=True)
    minus = {c: F.when(F.col("Flag") == "D", -1).otherwise(F.col(c)) for c in ("product_id", "add_to_cart_order", "reordered")}
    attributes = b.orders.select(
        "user_id", "order_id", "order_number", "order_dow", "order_hour_of_day", "days_since_prior_order", "eval_set"
    )
    return attributes.join(lines.withColumns(minus), "order_id", "left")


def known_lines(log: DataFrame) -> DataFrame:
    """Rows of the unified log that name a product."""
    return log.filter(F.col("product_id").isNotNull() & (F.col("product_id") != -1))


def eval_map(orders: DataFrame) -> DataFrame:
    """User to 'Train' or 'Test', the set of the user's target order."""

    def part(name: str) -> DataFrame:
        return orders.filter(F.col("eval_set") == name).select("user_id", F.lit(name.capitalize()).alias("Flag"))

    return part("train").unionByName(part("test"))


def calendar(moment: Column) -> dict[str, Column]:
    """Calendar attributes of a date or timestamp."""
    return {
        "order_dow": F.dayofweek(moment) - 1,
        "week_day_name": F.date_format(moment, "EEEE"),
        "cal_month_nbr": F.month(moment),
        "cal_month_name": F.date_format(moment, "MMMM"),
        "cal_qtr_nbr": F.quarter(moment),
        "cal_year_nbr": F.year(moment),
        "cal_week_nbr": F.weekofyear(moment),
    }


def purchase_log(b: Baskets, ranks: DataFrame) -> DataFrame:
    """The 20-column purchase log: one row per line with next dates and calendar attributes.

    The next purchase comes from a scan along the pair's purchases, newest first; the next order is found by
    joining on the following position, which spreads over (user, position) however long one history is.
    """
    days = F.col("days_since_prior_order")
    lines = ordered_scan(
        b.lines.withColumn("__back", -F.col("pair_nth")),
        ["user_id", "product_id"],
        ["__back"],
        [position_block("__back")],
        previous={"cust_prod_lead_date": F.when(F.col("user_id").isNotNull() & F.col("product_id").isNotNull(), F.col("order_date"))},
        whole={"__days": ("sum", days), "__known": ("sum", days.isNotNull().cast("int"))},
        split=b.split,
    )
    following_order = b.orders.select(
        "user_id", (F.col("order_number") - 1).alias("order_number"), F.col("order_date").alias("cust_lead_date")
    )
    log = lines.join(following_order, ["user_id", "order_number"], "left")
    log = lookup_join(log, ranks, "user_id").withColumns(calendar(F.col("order_date")))
    return log.select(
        "user_id",
        F.col("order_date").alias("visit_date"),
        F.col("product_id").cast("int").alias("product_id"),
        "units",
        "dollars",
        "cust_lead_date",
        "cust_prod_lead_date",
        "order_id",
        "reordered",
        days.cast("double").alias("days_since_prior_order"),
        ratio("__days", "__known").alias("cust_prod_aog"),
        "order_dow",
        "week_day_name",
        "cal_month_nbr",
        "cal_month_name",
        "cal_qtr_nbr",
        "cal_year_nbr",
        "cal_week_nbr",
        "rank_cust",
        F.col("rank_order").cast("int").alias("train_test"),
    )
