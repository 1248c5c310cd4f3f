"""Aggregates and sequential operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise.operators.joins import lookup_join
from cartwise.plans import gaps, recency, stats
from cartwise.registry import query
from cartwise.sources.baskets import load


def _pairs(spark, sf):
    return stats.pairs(load(spark, sf).prior)


@query("order_size", "order_id,order_size:i", "SELECT order_id, count(*) AS order_size FROM c_lines GROUP BY order_id")
def order_size(spark, sf):
    return load(spark, sf).lines.groupBy("order_id").agg(F.count("*").alias("order_size"))


@query(
    "product_stat",
    "product_id,prod_orders,prod_reorders:i prod_add_to_card_mean,reorder_ration,reorder_prob:d",
    "SELECT s.*, p.reorder_prob FROM c_product_stat s JOIN c_reorder_prob p ON p.product_id = s.product_id",
)
def product_stat(spark, sf):
    return stats.product_stat(_pairs(spark, sf))


@query("product_reorder_prob", "product_id:i reorder_prob:d", "SELECT * FROM c_reorder_prob")
def product_reorder_prob(spark, sf):
    return stats.product_stat(_pairs(spark, sf))


@query("product_user_reach", "product_id,prod_users_unq,prod_users_unq_reordered:i", "SELECT * FROM c_reach")
def product_user_reach(spark, sf):
    return stats.product_stat(_pairs(spark, sf))


REPEAT_SQL = """
    SELECT product_id, count(*) AS prod_orders,
        sum(CASE WHEN product_time = 2 THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN product_time = 1 THEN 1 ELSE 0 END)
            AS prod_reorder_probability,
        1 + sum(reordered)::DOUBLE / sum(CASE WHEN product_time = 1 THEN 1 ELSE 0 END) AS prod_reorder_times,
        sum(reordered)::DOUBLE / count(*) AS prod_reorder_ratio
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number) AS product_time FROM c_prior)
    GROUP BY product_id"""


@query(
    "product_repeat_stat",
    "product_id,prod_orders:i prod_reorder_probability,prod_reorder_times,prod_reorder_ratio:d",
    REPEAT_SQL,
)
def product_repeat_stat(spark, sf):
    return stats.product_repeat_stat(_pairs(spark, sf))


@query(
    "purchase_number",
    "user_id,product_id,order_id,product_time:i",
    """SELECT user_id, product_id, order_id, row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number)
       AS product_time FROM c_prior""",
)
def purchase_number(spark, sf):
    return load(spark, sf).prior.withColumnRenamed("pair_nth", "product_time")


@query(
    "user_stat",
    "user_id,user_orders,user_order_starts_at:i user_mean_days_since_prior,user_median_days_since_prior:d",
    "SELECT * FROM c_user_stat",
)
def user_stat(spark, sf):
    return stats.user_stat(load(spark, sf).prior_orders)


@query(
    "user_basket_stat",
    "user_id,user_total_products,user_distinct_products:i user_reorder_ratio,user_average_basket:d",
    "SELECT * FROM c_basket_stat",
)
def user_basket_stat(spark, sf):
    return stats.user_basket_stat(_pairs(spark, sf), stats.user_stat(load(spark, sf).prior_orders))


@query(
    "user_reorder_ratio",
    "user_id:i user_reorder_ratio:d",
    """SELECT user_id, CASE WHEN count(*) FILTER (order_number > 1) > 0
       THEN sum(reordered)::DOUBLE / count(*) FILTER (order_number > 1) END AS user_reorder_ratio FROM c_prior GROUP BY user_id""",
)
def user_reorder_ratio(spark, sf):
    return stats.user_reorder_ratio(load(spark, sf).prior)


UP_SPEC = (
    "user_id,product_id,up_orders,up_first_order,up_last_order,reordered_sum:i user_product_reordered_ratio,"
    + ",".join(name for both in stats.SPREAD.values() for name in both)
    + ":d"
)


@query("user_product_stat", UP_SPEC, "SELECT * FROM c_up_stat")
def user_product_stat(spark, sf):
    return stats.user_product_stat(load(spark, sf).prior)


@query(
    "up_rates",
    "user_id,product_id,up_orders,user_orders,reordered_sum,up_orders_since_last_order:i user_product_reordered_ratio,"
    "up_order_rate,up_order_rate_since_first_order,up_orders_per_order_since_first:d",
    "SELECT * FROM c_up_rates",
)
def up_rates(spark, sf):
    b = load(spark, sf)
    return stats.up_rates(b.prior, b.prior_orders)


@query(
    "user_department_stat",
    "user_id,department_id,dep_products,dep_reordered:i",
    "SELECT * FROM c_department_stat",
)
def user_department_stat(spark, sf):
    return stats.category_stat(_pairs(spark, sf), load(spark, sf).products, "department_id", "dep")


@query("user_aisle_stat", "user_id,aisle_id,aisle_products,aisle_reordered:i", "SELECT * FROM c_aisle_stat")
def user_aisle_stat(spark, sf):
    return stats.category_stat(_pairs(spark, sf), load(spark, sf).products, "aisle_id", "aisle")


@query(
    "user_product_last_order",
    "user_id,product_id,nb_orders,sum_pos_in_cart,last_order_id,last_order_number,last_order_hour:i",
    """SELECT user_id, product_id, count(*) AS nb_orders, sum(add_to_cart_order) AS sum_pos_in_cart,
       arg_max(order_id, order_number) AS last_order_id, max(order_number) AS last_order_number,
       arg_max(order_hour_of_day, order_number) AS last_order_hour FROM c_prior GROUP BY user_id, product_id""",
)
def user_product_last_order(spark, sf):
    return stats.last_order(load(spark, sf).prior)


@query(
    "user_product_set",
    "user_id:i all_products:a total_distinct_items:i",
    """SELECT user_id, list_sort(list(DISTINCT product_id)) AS all_products, count(DISTINCT product_id) AS total_distinct_items
       FROM c_prior GROUP BY user_id""",
)
def user_product_set(spark, sf):
    """Distinct products per user; at most the catalogue per row."""
    sets = load(spark, sf).prior.groupBy("user_id").agg(F.array_sort(F.collect_set("product_id")).alias("all_products"))
    return sets.withColumn("total_distinct_items", F.size("all_products"))


@query(
    "basket_sequences",
    "order_id:i products:a",
    "SELECT order_id, list(product_id ORDER BY add_to_cart_order) AS products FROM c_lines GROUP BY order_id",
)
def basket_sequences(spark, sf):
    items = F.array_sort(F.collect_list(F.struct("add_to_cart_order", "product_id")))
    baskets = load(spark, sf).lines.groupBy("order_id").agg(items.alias("items"))
    return baskets.select("order_id", F.col("items.product_id").alias("products"))


@query(
    "basket_extremes",
    "longest_basket,max_product,min_order,max_order:i first_visit,last_visit:s",
    """SELECT max(n) AS longest_basket, max(p) AS max_product, min(order_id) AS min_order, max(order_id) AS max_order,
       min(d) AS first_visit, max(d) AS last_visit
       FROM (SELECT order_id, count(*) AS n, max(product_id) AS p, any_value(order_date) AS d FROM c_lines GROUP BY order_id)""",
)
def basket_extremes(spark, sf):
    return load(spark, sf).lines.agg(
        F.max("order_size").alias("longest_basket"),
        F.max("product_id").alias("max_product"),
        F.min("order_id").alias("min_order"),
        F.max("order_id").alias("max_order"),
        F.min("order_date").alias("first_visit"),
        F.max("order_date").alias("last_visit"),
    )


@query(
    "order_timeline",
    "user_id,order_id,order_number,days_since_prior_order_comsum:i",
    "SELECT *, timeline AS days_since_prior_order_comsum FROM c_orders",
)
def order_timeline(spark, sf):
    b = load(spark, sf)
    return gaps.order_timeline(b.orders, b.split)


@query("purchase_gaps", "user_id,product_id,order_number,gap,gap_no:i", "SELECT * FROM c_gaps")
def purchase_gaps(spark, sf):
    return gaps.purchase_gaps(load(spark, sf).prior)


GAP_SPEC = "user_id,product_id:i last,prev1,prev2:n median,mean,sdev:d"


@query("purchase_gap_stats", GAP_SPEC, "SELECT * FROM c_gap_stats")
def purchase_gap_stats(spark, sf):
    return gaps.purchase_gap_stats(gaps.numbered_gaps(load(spark, sf).prior))


@query(
    "purchase_gap_stats_target",
    GAP_SPEC,
    """SELECT p.user_id, p.product_id, max(gap) FILTER (gap_no = 1) AS last, max(gap) FILTER (gap_no = 2) AS prev1,
           max(gap) FILTER (gap_no = 3) AS prev2, median(gap) FILTER (gap_no >= 2) AS median,
           avg(gap) FILTER (gap_no >= 2) AS mean, stddev_pop(gap) FILTER (gap_no >= 2) AS sdev
       FROM (SELECT DISTINCT user_id, product_id FROM c_lines) p
       LEFT JOIN c_gaps_target g ON g.user_id = p.user_id AND g.product_id = p.product_id
       GROUP BY p.user_id, p.product_id""",
)
def purchase_gap_stats_target(spark, sf):
    return gaps.purchase_gap_stats(gaps.numbered_gaps(load(spark, sf).lines, with_target=True))


@query(
    "gap_arrays",
    "user_id,product_id,chunk:i periods,all_but_newest:a newest,second_newest,third_newest:n",
    """SELECT user_id, product_id, (order_number - 1) // 1000 AS chunk, list(gap ORDER BY order_number) AS periods,
           coalesce(list(gap ORDER BY order_number) FILTER (gap_no > 1), []) AS all_but_newest,
           any_value(newest) AS newest, any_value(second_newest) AS second_newest, any_value(third_newest) AS third_newest
       FROM (SELECT *, max(gap) FILTER (gap_no = 1) OVER pair AS newest, max(gap) FILTER (gap_no = 2) OVER pair AS second_newest,
                 max(gap) FILTER (gap_no = 3) OVER pair AS third_newest
             FROM c_gaps WINDOW pair AS (PARTITION BY user_id, product_id))
       GROUP BY user_id, product_id, chunk""",
)
def gap_arrays(spark, sf):
    """Gaps as arrays, oldest first, in chunks of a thousand orders of the user.

    The newest three are those of the pair and stand in each of its few chunks.
    """
    from pyspark.sql import Window

    chunk = F.floor((F.col("order_number") - 1) / 1000)
    ordered = F.array_sort(F.collect_list(F.struct("order_number", "gap", "gap_no")))
    newest = ("newest", "second_newest", "third_newest")
    arrays = (
        gaps.purchase_gaps(load(spark, sf).prior)
        .groupBy("user_id", "product_id", chunk.alias("chunk"))
        .agg(
            ordered.alias("g"),
            *[F.max(F.when(F.col("gap_no") == k + 1, F.col("gap"))).alias(name) for k, name in enumerate(newest)],
        )
    )
    pair = Window.partitionBy("user_id", "product_id")
    return arrays.select(
        "user_id",
        "product_id",
        "chunk",
        F.col("g.gap").alias("periods"),
        F.transform(F.filter("g", lambda x: x.gap_no > 1), lambda x: x.gap).alias("all_but_newest"),
        *[F.max(name).over(pair).alias(name) for name in newest],
    )


@query(
    "cart_position_rank",
    "order_id,product_id,cart_rank:i",
    "SELECT order_id, product_id, dense_rank() OVER (PARTITION BY user_id, order_id ORDER BY product_id) AS cart_rank FROM c_lines",
)
def cart_position_rank(spark, sf):
    """Cart position where none is recorded: dense rank of the product id in its order."""
    from pyspark.sql import Window

    by_id = Window.partitionBy("order_id").orderBy("product_id")
    return load(spark, sf).lines.withColumn("cart_rank", F.dense_rank().over(by_id))


@query(
    "cart_position_features",
    "order_id,product_id,order_size,add_to_cart_order_inverted:i add_to_cart_order_relative:d",
    "SELECT * FROM c_sized",
)
def cart_position_features(spark, sf):
    return stats.with_cart_features(load(spark, sf).prior)


RANK_SQL = "SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY order_number DESC) AS order_rank FROM c_lines"


@query("order_recency_rank", "order_id,user_id,product_id,order_rank:i", RANK_SQL)
def order_recency_rank(spark, sf):
    b = load(spark, sf)
    return recency.with_order_rank(b.lines, b.split)


@query(
    "product_recency_rank",
    "order_id,user_id,product_id,prod_rank_order:i",
    """SELECT order_id, user_id, product_id,
       dense_rank() OVER (PARTITION BY user_id, product_id ORDER BY order_number DESC) AS prod_rank_order FROM c_prior""",
)
def product_recency_rank(spark, sf):
    return recency.product_recency_rank(load(spark, sf).prior)


@query(
    "latest_vs_history",
    "user_id,latest_orders,latest_lines,history_orders,history_lines:i",
    f"""SELECT user_id, count(DISTINCT CASE WHEN order_rank = 1 THEN order_id END) AS latest_orders,
        count(*) FILTER (order_rank = 1) AS latest_lines,
        count(DISTINCT CASE WHEN order_rank > 1 THEN order_id END) AS history_orders,
        count(*) FILTER (order_rank > 1) AS history_lines FROM ({RANK_SQL}) GROUP BY user_id""",
)
def latest_vs_history(spark, sf):
    b = load(spark, sf)
    orders = recency.ranked_orders(b.lines, b.split)
    latest = F.col("rank_order") == 1
    size = F.col("bask_size")
    return orders.groupBy("user_id").agg(
        stats.count_if(latest).alias("latest_orders"),
        F.sum(F.when(latest, size).otherwise(0)).alias("latest_lines"),
        stats.count_if(~latest).alias("history_orders"),
        F.sum(F.when(~latest, size).otherwise(0)).alias("history_lines"),
    )


@query(
    "user_departments_history",
    "user_id,department_id:i",
    f"""SELECT DISTINCT r.user_id, p.department_id FROM ({RANK_SQL}) r
        JOIN c_products p ON p.product_id = r.product_id WHERE r.order_rank > 1""",
)
def user_departments_history(spark, sf):
    b = load(spark, sf)
    history = recency.with_order_rank(b.lines, b.split).filter("order_rank > 1")
    pairs = history.select("user_id", "product_id").distinct()
    dims = b.products.select("product_id", "department_id")
    return lookup_join(pairs, dims, "product_id").select("user_id", "department_id").distinct()


@query(
    "order_reorder_size",
    "order_id,order_size,reorder_size:i",
    "SELECT order_id, count(*) AS order_size, sum(reordered) AS reorder_size FROM c_lines GROUP BY order_id",
)
def order_reorder_size(spark, sf):
    return load(spark, sf).lines.groupBy("order_id").agg(
        F.count("*").alias("order_size"), F.sum("reordered").alias("reorder_size")
    )


RECENCY_COLUMNS = (
    "upor{0},upro{0},latest_or{0},max_prod_ord{0},up_first_order{0},up_last_order{0},up_order_rate{0}:i "
    "avg_prod_ord{0},up_average_cart_position{0},upaog{0}:d"
)


def recency_sql(keys: str, suffix: str) -> str:
    """Ten measures over lines that carry both newest-first ranks."""
    return f"""
        SELECT {keys}, count(*) AS upor{suffix}, sum(reordered) AS upro{suffix}, min(rank_lines) AS latest_or{suffix},
            max(prod_rank_order) AS max_prod_ord{suffix}, avg(prod_rank_order) AS avg_prod_ord{suffix},
            min(order_number) AS up_first_order{suffix}, max(order_number) AS up_last_order{suffix},
            avg(add_to_cart_order) AS up_average_cart_position{suffix}, count(*) AS up_order_rate{suffix},
            avg(days_since_prior_order) AS upaog{suffix}
        FROM ({RANKED_LINES}) GROUP BY {keys}"""


RANKED_LINES = """
    SELECT l.*, p.aisle_id, p.department_id,
        dense_rank() OVER (PARTITION BY l.user_id ORDER BY order_number DESC) AS rank_lines,
        dense_rank() OVER (PARTITION BY l.user_id, l.product_id ORDER BY order_number DESC) AS prod_rank_order
    FROM c_prior l JOIN c_products p ON p.product_id = l.product_id"""


def _facts(spark, sf):
    b = load(spark, sf)
    dims = b.products.select("product_id", "aisle_id", "department_id")
    return lookup_join(recency.pair_facts(b, recency.ranked_orders(b.prior, b.split)), dims, "product_id")


@query(
    "user_product_recency",
    "user_id,product_id:i " + RECENCY_COLUMNS.format(""),
    recency_sql("user_id, product_id", ""),
)
def user_product_recency(spark, sf):
    return recency.pair_recency(_facts(spark, sf))


@query(
    "user_aisle_recency",
    "user_id,aisle_id:i " + RECENCY_COLUMNS.format("_a"),
    recency_sql("user_id, aisle_id", "_a"),
)
def user_aisle_recency(spark, sf):
    return recency.group_recency(_facts(spark, sf), ["user_id", "aisle_id"], "_a")


@query(
    "user_department_recency",
    "user_id,department_id:i " + RECENCY_COLUMNS.format("_d"),
    recency_sql("user_id, department_id", "_d"),
)
def user_department_recency(spark, sf):
    return recency.group_recency(_facts(spark, sf), ["user_id", "department_id"], "_d")


USER_RECENCY_SPEC = (
    "uror:d ul,udl,num_baskets,basket_size_lag,basket_size_lag1:i prod_ro_density,avg_basket_size,aog:d"
)
USER_RECENCY_SQL = f"""
    SELECT user_id, CASE WHEN count(*) FILTER (order_number > 1) > 0
            THEN sum(reordered)::DOUBLE / count(*) FILTER (order_number > 1) END AS uror,
        count(*) AS ul, count(DISTINCT product_id) AS udl, max(order_number) AS num_baskets,
        avg(prod_rank_order) AS prod_ro_density, count(*)::DOUBLE / max(order_number) AS avg_basket_size,
        count(*) FILTER (rank_lines = 1) AS basket_size_lag, count(*) FILTER (rank_lines = 2) AS basket_size_lag1,
        avg(days_since_prior_order) AS aog
    FROM ({RANKED_LINES}) GROUP BY user_id"""


@query("user_recency", "user_id:i " + USER_RECENCY_SPEC, USER_RECENCY_SQL)
def user_recency(spark, sf):
    b = load(spark, sf)
    orders = recency.ranked_orders(b.prior, b.split)
    return recency.user_recency(recency.pair_facts(b, orders), orders)


PRODUCT_RECENCY_SPEC = "pl,prod_reorders,prod_last_orders,prod_secondlast_orders:i pror,pur,ror_prob:d"
PRODUCT_RECENCY_SQL = f"""
    SELECT product_id, sum(reordered)::DOUBLE / count(*) AS pror, count(*) AS pl,
        count(DISTINCT CASE WHEN reordered = 1 THEN user_id END)::DOUBLE / count(DISTINCT user_id) AS pur,
        sum(reordered) AS prod_reorders, count(*) FILTER (prod_rank_order = 1) AS prod_last_orders,
        count(*) FILTER (prod_rank_order = 2) AS prod_secondlast_orders,
        count(*) FILTER (prod_rank_order = 2)::DOUBLE / count(*) FILTER (prod_rank_order = 1) AS ror_prob
    FROM ({RANKED_LINES}) GROUP BY product_id"""


@query("product_recency", "product_id:i " + PRODUCT_RECENCY_SPEC, PRODUCT_RECENCY_SQL)
def product_recency(spark, sf):
    return recency.product_recency(_facts(spark, sf))
