"""Composite feature marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise.plans import marts, recency, rolling
from cartwise.queries.statistics import (
    PRODUCT_RECENCY_SPEC,
    PRODUCT_RECENCY_SQL,
    RECENCY_COLUMNS,
    USER_RECENCY_SPEC,
    USER_RECENCY_SQL,
    REPEAT_SQL,
    recency_sql,
)
from cartwise.registry import query
from cartwise.sources.baskets import load

COUNTS = (
    "reordered_sum,last,prev1,prev2,aisle_products,aisle_reordered,dep_products,dep_reordered,prod_users_unq,"
    "prod_users_unq_reordered,order_number,order_dow,order_hour_of_day,user_orders,"
    "user_order_starts_at,user_distinct_products,user_total_products,prod_orders,prod_reorders,"
    "up_orders_since_last_order,up_orders,up_first_order,up_last_order"
).split(",")
MART_SPEC = (
    "order_id,user_id:i eval_set:s product_id,aisle_id,department_id:i "
    + " ".join(f"{name}:{'i' if name in COUNTS else 'd'}" for name in marts.FEATURES)
    + " reordered:i"
)
MART_SQL = """
    SELECT l.order_id, l.user_id, l.eval_set, l.product_id, p.aisle_id, p.department_id, l.reordered,
        u.user_product_reordered_ratio, u.reordered_sum, u.add_to_cart_order_inverted_mean, u.add_to_cart_order_relative_mean,
        u.up_orders, u.up_first_order, u.up_last_order, u.up_mean_cart_position, u.days_since_prior_order_mean,
        u.order_dow_mean, u.order_hour_of_day_mean, rp.reorder_prob,
        coalesce(g.last, 9999) AS last, coalesce(g.prev1, 9999) AS prev1, coalesce(g.prev2, 9999) AS prev2,
        coalesce(g.median, 9999) AS median, coalesce(g.mean, 9999) AS mean,
        d.dep_reordered::DOUBLE / s.user_orders AS dep_reordered_ratio,
        a.aisle_reordered::DOUBLE / s.user_orders AS aisle_reordered_ratio,
        a.aisle_products, a.aisle_reordered, d.dep_products, d.dep_reordered,
        r.prod_users_unq, r.prod_users_unq_reordered,
        o.order_number, o.days_since_prior_order, o.order_dow, o.order_hour_of_day,
        ps.prod_add_to_card_mean, ps.reorder_ration, ps.prod_orders, ps.prod_reorders,
        s.user_orders, s.user_order_starts_at, s.user_mean_days_since_prior,
        b.user_average_basket, b.user_distinct_products, b.user_reorder_ratio, b.user_total_products,
        ur.up_order_rate, ur.up_orders_since_last_order, ur.up_order_rate_since_first_order
    FROM c_labels l
    JOIN c_products p ON p.product_id = l.product_id
    JOIN c_orders o ON o.order_id = l.order_id
    JOIN c_department_stat d ON d.user_id = l.user_id AND d.department_id = p.department_id
    JOIN c_aisle_stat a ON a.user_id = l.user_id AND a.aisle_id = p.aisle_id
    JOIN c_reach r ON r.product_id = l.product_id
    JOIN c_reorder_prob rp ON rp.product_id = l.product_id
    JOIN c_product_stat ps ON ps.product_id = l.product_id
    JOIN c_up_stat u ON u.user_id = l.user_id AND u.product_id = l.product_id
    JOIN c_up_rates ur ON ur.user_id = l.user_id AND ur.product_id = l.product_id
    JOIN c_user_stat s ON s.user_id = l.user_id
    JOIN c_basket_stat b ON b.user_id = l.user_id
    JOIN c_gap_stats g ON g.user_id = l.user_id AND g.product_id = l.product_id"""


@query("training_mart", MART_SPEC, MART_SQL)
def training_mart(spark, sf):
    return marts.training_mart(load(spark, sf))


EMBEDDED = ",".join(f"feature_{i}" for i in range(32))


@query(
    "mart_with_embeddings",
    f"{MART_SPEC} {EMBEDDED}:d",
    "SELECT m.*, "
    + ", ".join(f"e.embedding[{i + 1}] AS feature_{i}" for i in range(64))
    + f" FROM ({MART_SQL}) m JOIN embeddings e ON e.vec_id = m.product_id",
)
def mart_with_embeddings(spark, sf):
    embeddings = spark.read.parquet(f"{sf}/embeddings.parquet")
    return marts.with_embeddings(marts.training_mart(load(spark, sf)), embeddings)


@query(
    "lgbm_features",
    "order_id,user_id,product_id:i eval_set:s label,user_total_orders,user_total_items,total_distinct_items:i "
    "user_average_days_between_orders,user_average_basket:d order_hour_of_day:i days_since_prior_order:n "
    "days_since_ratio:d aisle_id,department_id,product_orders,product_reorders:i product_reorder_rate:d UP_orders:i "
    "UP_orders_ratio,UP_average_pos_in_cart,UP_reorder_rate:d UP_orders_since_last,UP_delta_hour_vs_last:i",
    """SELECT l.order_id, l.user_id, l.product_id, l.eval_set, l.reordered AS label,
        n.user_total_orders, b.user_total_products AS user_total_items, b.user_distinct_products AS total_distinct_items,
        n.gap AS user_average_days_between_orders, b.user_total_products::DOUBLE / n.user_total_orders AS user_average_basket,
        o.order_hour_of_day, o.days_since_prior_order,
        CASE WHEN n.gap <> 0 THEN o.days_since_prior_order / n.gap END AS days_since_ratio,
        p.aisle_id, p.department_id, ps.prod_orders AS product_orders, ps.prod_reorders AS product_reorders,
        ps.reorder_ration AS product_reorder_rate, u."UP_orders", u."UP_orders"::DOUBLE / n.user_total_orders AS "UP_orders_ratio",
        u.pos AS "UP_average_pos_in_cart", u."UP_orders"::DOUBLE / n.user_total_orders AS "UP_reorder_rate",
        n.user_total_orders - u.last_number AS "UP_orders_since_last",
        least(abs(o.order_hour_of_day - u.last_hour), 24 - abs(o.order_hour_of_day - u.last_hour)) AS "UP_delta_hour_vs_last"
    FROM c_labels l
    JOIN c_products p ON p.product_id = l.product_id
    JOIN c_orders o ON o.order_id = l.order_id
    JOIN (SELECT user_id, count(*) AS user_total_orders, avg(days_since_prior_order) AS gap FROM c_orders GROUP BY user_id) n
        ON n.user_id = l.user_id
    JOIN c_basket_stat b ON b.user_id = l.user_id
    JOIN c_product_stat ps ON ps.product_id = l.product_id
    JOIN (SELECT user_id, product_id, count(*) AS "UP_orders", avg(add_to_cart_order) AS pos,
            max(order_number) AS last_number, arg_max(order_hour_of_day, order_number) AS last_hour
          FROM c_prior GROUP BY user_id, product_id) u ON u.user_id = l.user_id AND u.product_id = l.product_id""",
)
def lgbm_features(spark, sf):
    return marts.lgbm_features(load(spark, sf))


@query(
    "compact_mart",
    "order_id,user_id,product_id:i eval_set:s up_orders,up_first_order,up_last_order:i up_average_cart_position:d "
    "user_orders,user_period:i user_mean_days_since_prior:d user_total_products:i user_reorder_ratio:d "
    "user_distinct_products:i user_average_basket:d time_since_last_order:n up_order_rate:d up_orders_since_last_order:i "
    "up_order_rate_since_first_order,up_orders_per_order_since_first:d prod_orders:i "
    "prod_reorder_probability,prod_reorder_times,prod_reorder_ratio:d reordered:i",
    f"""SELECT l.order_id, l.user_id, l.product_id, l.eval_set, u.up_orders, u.up_first_order, u.up_last_order,
        u.up_mean_cart_position AS up_average_cart_position, s.user_orders, s.user_order_starts_at AS user_period,
        s.user_mean_days_since_prior, b.user_total_products, b.user_distinct_products, b.user_average_basket,
        CASE WHEN w.later > 0 THEN w.again::DOUBLE / w.later END AS user_reorder_ratio,
        o.days_since_prior_order AS time_since_last_order, r.up_order_rate, r.up_orders_since_last_order,
        r.up_order_rate_since_first_order, r.up_orders_per_order_since_first,
        t.prod_orders, t.prod_reorder_probability, t.prod_reorder_times, t.prod_reorder_ratio, l.reordered
    FROM c_labels l JOIN c_orders o ON o.order_id = l.order_id
    JOIN c_up_stat u ON u.user_id = l.user_id AND u.product_id = l.product_id
    JOIN c_up_rates r ON r.user_id = l.user_id AND r.product_id = l.product_id
    JOIN c_user_stat s ON s.user_id = l.user_id JOIN c_basket_stat b ON b.user_id = l.user_id
    JOIN (SELECT user_id, sum(reordered) AS again, count(*) FILTER (order_number > 1) AS later FROM c_prior GROUP BY user_id) w
        ON w.user_id = l.user_id
    JOIN ({REPEAT_SQL}) t ON t.product_id = l.product_id""",
)
def compact_mart(spark, sf):
    return marts.compact_mart(load(spark, sf))


def _zero(columns: str) -> str:
    return ", ".join(f"coalesce({c}, 0) AS {c}" for c in columns.split(","))


RECENCY_NULLS = "upaog,upaog_a,upaog_d,uror,aog"


@query(
    "recency_mart",
    "user_id,product_id,aisle_id,department_id:i flag:s "
    + " ".join(RECENCY_COLUMNS.format(s) for s in ("", "_a", "_d"))
    + f" {USER_RECENCY_SPEC} {PRODUCT_RECENCY_SPEC} "
    "up_order_rate_p,up_order_rate_share_a,up_order_rate_share_d:d up_orders_since_last_order_p,up_orders_since_last_order_a,"
    "up_orders_since_last_order_d:i up_order_rate_since_first_order_p,up_order_rate_since_first_order_a,"
    "up_order_rate_since_first_order_d:d reordered:i",
    f"""SELECT p.* EXCLUDE (upaog), a.* EXCLUDE (user_id, aisle_id, upaog_a), d.* EXCLUDE (user_id, department_id, upaog_d),
        c.aisle_id, c.department_id, u.* EXCLUDE (user_id, uror, aog), r.* EXCLUDE (product_id), {_zero(RECENCY_NULLS)},
        o.eval_set AS flag, CASE WHEN t.product_id IS NULL THEN 0 ELSE 1 END AS reordered,
        upor::DOUBLE / num_baskets AS up_order_rate_p, upor_a::DOUBLE / num_baskets AS up_order_rate_share_a,
        upor_d::DOUBLE / num_baskets AS up_order_rate_share_d,
        num_baskets - up_last_order AS up_orders_since_last_order_p,
        num_baskets - up_last_order_a AS up_orders_since_last_order_a,
        num_baskets - up_last_order_d AS up_orders_since_last_order_d,
        upor::DOUBLE / (num_baskets - up_first_order + 1) AS up_order_rate_since_first_order_p,
        upor_a::DOUBLE / (num_baskets - up_first_order_a + 1) AS up_order_rate_since_first_order_a,
        upor_d::DOUBLE / (num_baskets - up_first_order_d + 1) AS up_order_rate_since_first_order_d
    FROM ({recency_sql("user_id, product_id", "")}) p
    JOIN c_products c ON c.product_id = p.product_id
    JOIN ({recency_sql("user_id, aisle_id", "_a")}) a ON a.user_id = p.user_id AND a.aisle_id = c.aisle_id
    JOIN ({recency_sql("user_id, department_id", "_d")}) d ON d.user_id = p.user_id AND d.department_id = c.department_id
    JOIN ({USER_RECENCY_SQL}) u ON u.user_id = p.user_id
    JOIN ({PRODUCT_RECENCY_SQL}) r ON r.product_id = p.product_id
    JOIN c_orders o ON o.user_id = p.user_id AND o.eval_set <> 'prior'
    LEFT JOIN c_target t ON t.user_id = p.user_id AND t.product_id = p.product_id""",
)
def recency_mart(spark, sf):
    return recency.recency_mart(load(spark, sf))


SEGMENT_SQL = """
    SELECT *, CASE WHEN dec IN (1, 2) THEN 'Segment1' WHEN dec IN (3, 4, 5) THEN 'Segment2'
        WHEN dec IN (6, 7, 8) THEN 'Segment3' ELSE 'Segment4' END AS "Segment"
    FROM (SELECT *, ntile(10) OVER (ORDER BY reorder_rate, user_id) AS dec
          FROM (SELECT user_id, sum(reordered)::DOUBLE / count(*) AS reorder_rate, count(*) AS lengt
                FROM c_prior GROUP BY user_id))"""


@query("user_segments", "user_id:i reorder_rate:d lengt,dec:i Segment:s", SEGMENT_SQL)
def user_segments(spark, sf):
    return marts.user_segments(load(spark, sf).prior)


PROFILE_SQL = f"""
    SELECT p.*, s.reorder_rate AS rate, s.lengt, s."Segment", upper(o.eval_set[1]) || o.eval_set[2:] AS "Flag"
    FROM (SELECT user_id, rank_order, count(*) AS bask_size, sum(reordered)::DOUBLE / count(*) AS reorder_rate,
            avg(order_dow) AS order_dow, avg(order_hour_of_day) AS order_hour_of_day,
            avg(days_since_prior_order) AS days_since_prior_order
          FROM (SELECT * EXCLUDE (rank_order), dense_rank() OVER (PARTITION BY user_id ORDER BY order_number DESC) AS rank_order
                FROM c_prior)
          GROUP BY user_id, rank_order) p
    JOIN ({SEGMENT_SQL}) s ON s.user_id = p.user_id
    JOIN c_orders o ON o.user_id = p.user_id AND o.eval_set <> 'prior'"""


@query(
    "order_profile",
    "user_id,rank_order,bask_size:i reorder_rate,order_dow,order_hour_of_day,days_since_prior_order,rate:d lengt:i Segment,Flag:s",
    PROFILE_SQL,
)
def order_profile(spark, sf):
    return marts.order_profile(load(spark, sf))


def _size_part(part: str, skip: int) -> str:
    return f"""
    SELECT h.user_id, '{part}' AS part, l1.bask_size AS bask_size_lag, l2.bask_size AS bask_size_lag1,
        coalesce(l3.bask_size, 0) AS bask_size_lag2,
        (coalesce(l1.bask_size, 0) + coalesce(l2.bask_size, 0) + coalesce(l3.bask_size, 0))::DOUBLE
          / (CASE WHEN l1.bask_size IS NULL THEN 0 ELSE 1 END + CASE WHEN l2.bask_size IS NULL THEN 0 ELSE 1 END
             + CASE WHEN l3.bask_size IS NULL THEN 0 ELSE 1 END) AS avg_bask_lag,
        h.* EXCLUDE (user_id), {'d.bask_size' if skip else 'NULL'} AS dep
    FROM (SELECT user_id, avg(bask_size) AS avg_b, max(bask_size) AS max_b, min(bask_size) AS min_b, median(bask_size) AS mode_b,
            max("Segment") AS "Segment", max(rank_order) AS num_orders, avg(reorder_rate) AS reorder_rate,
            avg(order_dow) AS order_dow, avg(order_hour_of_day) AS order_hour_of_day,
            avg(days_since_prior_order) AS days_since_prior_order, avg(rate) AS rate, avg(lengt) AS lengt
          FROM profile WHERE rank_order > {skip} GROUP BY user_id) h
    LEFT JOIN profile d ON d.user_id = h.user_id AND d.rank_order = 1
    LEFT JOIN profile l1 ON l1.user_id = h.user_id AND l1.rank_order = {skip + 1}
    LEFT JOIN profile l2 ON l2.user_id = h.user_id AND l2.rank_order = {skip + 2}
    LEFT JOIN profile l3 ON l3.user_id = h.user_id AND l3.rank_order = {skip + 3}"""


SIZE_SQL = (
    f"profile AS MATERIALIZED (SELECT * FROM ({PROFILE_SQL}) WHERE \"Flag\" = 'Test');;"
    f"{_size_part('train', 1)} UNION ALL {_size_part('score', 0)}"
)


@query(
    "basket_size_mart",
    "user_id:i part:s bask_size_lag,bask_size_lag1,bask_size_lag2:n avg_bask_lag,avg_b:d max_b,min_b:i mode_b:d Segment:s "
    "num_orders:i reorder_rate,order_dow,order_hour_of_day,days_since_prior_order,rate,lengt:d dep:n",
    SIZE_SQL,
)
def basket_size_mart(spark, sf):
    return marts.basket_size_mart(marts.order_profile(load(spark, sf)))


SNAPSHOT_SPEC = (
    "user_id,product_id,prod_users_unq,prod_users_unq_reordered,up_orders,up_first_order,up_last_order,reordered_sum:i "
    "days_since_prior_order_mean,days_since_prior_order_median,order_dow_mean,order_dow_median,"
    "user_product_reordered_ratio:d prod_orders,prod_reorders:i reorder_ration,reorder_prob:d user_orders,"
    "user_order_starts_at:i user_mean_days_since_prior,user_median_days_since_prior:d user_total_products,"
    "user_distinct_products:i user_reorder_ratio,user_average_basket,up_order_rate:d up_orders_since_last_order:i "
    "up_order_rate_since_first_order:d last,prev1,prev2:i median,mean,sdev:d reordered,rank_cust:i"
)


def _fill(alias: str, columns: str) -> str:
    return ", ".join(f"coalesce({alias}.{c}, 999) AS {c}" for c in columns.split(","))


@query(
    "snapshot_mart",
    f"{SNAPSHOT_SPEC} part:s",
    f"""SELECT u.user_id, u.product_id, re.prod_users_unq, re.prod_users_unq_reordered, u.up_orders, u.up_first_order,
        u.up_last_order, u.reordered_sum, {_fill('u', 'days_since_prior_order_mean,days_since_prior_order_median')},
        u.order_dow_mean, u.order_dow_median, u.user_product_reordered_ratio, ps.prod_orders, ps.prod_reorders,
        ps.reorder_ration, rp.reorder_prob, s.user_orders, s.user_order_starts_at,
        {_fill('s', 'user_mean_days_since_prior,user_median_days_since_prior')},
        b.user_total_products, b.user_distinct_products, b.user_reorder_ratio, b.user_average_basket,
        r.up_order_rate, r.up_orders_since_last_order, r.up_order_rate_since_first_order,
        {_fill('g', 'last,prev1,prev2,median,mean,sdev')}, l.reordered, c.rank_cust,
        CASE WHEN c.rank_cust > ceil((SELECT count(DISTINCT user_id) FROM c_orders) * 0.9::DOUBLE) THEN 'test' ELSE 'train' END AS part
    FROM c_labels l
    JOIN c_up_stat u ON u.user_id = l.user_id AND u.product_id = l.product_id
    JOIN c_up_rates r ON r.user_id = l.user_id AND r.product_id = l.product_id
    JOIN c_gap_stats g ON g.user_id = l.user_id AND g.product_id = l.product_id
    JOIN c_product_stat ps ON ps.product_id = l.product_id JOIN c_reach re ON re.product_id = l.product_id
    JOIN c_reorder_prob rp ON rp.product_id = l.product_id
    JOIN c_user_stat s ON s.user_id = l.user_id JOIN c_basket_stat b ON b.user_id = l.user_id
    JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id) AS rank_cust FROM (SELECT DISTINCT user_id FROM c_orders)) c
        ON c.user_id = l.user_id""",
)
def snapshot_mart(spark, sf):
    return marts.snapshot_mart(load(spark, sf))


def rolling_ctes(horizon: int = 1) -> str:
    """Days, starts and lines by start. A window starting on day s is train window s and test window s - 15."""
    return f"""
    m AS (SELECT min(order_date) AS d, greatest(0, date_diff('day', min(order_date), max(order_date)) - 120 - 15 - {horizon}) AS last
          FROM c_lines),
    dated AS MATERIALIZED (SELECT l.*, date_diff('day', m.d, l.order_date) AS off FROM c_lines l, m),
    held AS (SELECT * EXCLUDE (last), unnest(range(greatest(off - 120, 0), least(off, last + 15) + 1)) AS s
             FROM (SELECT dated.*, m.last FROM dated, m)),
    splits AS (SELECT * FROM (VALUES ('train', 0), ('test', 15)) x(split, shift))"""


# Ranges of starts as ranges of window counters.
CLIPPED = """SELECT split, greatest(lo - shift, 0) AS first_counter, least(hi - shift, m.last) AS last_counter, r.* EXCLUDE (lo, hi)
    FROM {rows} r, splits, m WHERE greatest(lo - shift, 0) <= least(hi - shift, m.last)"""


@query(
    "rolling_snapshots",
    "split:s counter,order_id,user_id,product_id:i",
    f"""{rolling_ctes()};;
    SELECT split, s - shift AS counter, order_id, user_id, product_id FROM held, splits, m
    WHERE s - shift BETWEEN 0 AND m.last""",
)
def rolling_snapshots(spark, sf):
    """All lines once per daily window that holds them."""
    return rolling.snapshots(load(spark, sf))


def label_sql(horizon: int) -> str:
    """Label of every pair and start, start by start, then equal neighbours as one range."""
    return f"""{rolling_ctes(horizon)},
    hits AS (SELECT DISTINCT user_id, product_id,
                unnest(range(greatest(off - 120 - {horizon}, 0), least(off - 121, m.last + 15) + 1)) AS s FROM dated, m),
    flags AS (SELECT h.*, (y.s IS NOT NULL)::INT AS reordered FROM (SELECT DISTINCT user_id, product_id, s FROM held) h
              LEFT JOIN hits y ON y.user_id = h.user_id AND y.product_id = h.product_id AND y.s = h.s),
    each AS (SELECT user_id, product_id, reordered, min(s) AS lo, max(s) AS hi
             FROM (SELECT *, s - row_number() OVER (PARTITION BY user_id, product_id, reordered ORDER BY s) AS island FROM flags)
             GROUP BY user_id, product_id, reordered, island);;
    {CLIPPED.format(rows="each")}"""


@query("rolling_labels", "split:s first_counter,last_counter,user_id,product_id,reordered:i", label_sql(1))
def rolling_labels(spark, sf):
    return rolling.label_ranges(load(spark, sf))


@query("rolling_labels_month", "split:s first_counter,last_counter,user_id,product_id,reordered:i", label_sql(30))
def rolling_labels_month(spark, sf):
    """Labels over the thirty days after each window instead of the next day."""
    return rolling.label_ranges(load(spark, sf), rolling.Windows(horizon_days=30))


@query(
    "rolling_products",
    "split:s counter,product_id,prod_orders,prod_reorders:i reorder_ration,reorder_prob:d prod_users_unq,prod_users_unq_reordered:i",
    f"""{rolling_ctes()},
    up AS (SELECT s, product_id, user_id, count(*) AS n, sum(reordered) AS again FROM held GROUP BY ALL);;
    SELECT split, s - shift AS counter, p.* EXCLUDE (s) FROM (
        SELECT s, product_id, sum(n) AS prod_orders, sum(again) AS prod_reorders, sum(again)::DOUBLE / sum(n) AS reorder_ration,
            avg(CASE WHEN again > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS reorder_prob,
            count(*) AS prod_users_unq, count(*) FILTER (again > 0) AS prod_users_unq_reordered
        FROM up GROUP BY ALL) p, splits, m WHERE s - shift BETWEEN 0 AND m.last""",
)
def rolling_products(spark, sf):
    """Statistics of every product in every daily window."""
    return rolling.product_windows(load(spark, sf))


PRODUCT_COLUMNS = "prod_orders prod_reorders reorder_ration reorder_prob prod_users_unq prod_users_unq_reordered".split()
RANGE_SPEC = (
    "split:s first_counter,last_counter,user_id,product_id,up_orders,up_first_order,up_last_order,reordered_sum:i "
    "days_since_prior_order_mean,days_since_prior_order_median,order_dow_mean,order_dow_median,"
    "user_product_reordered_ratio:d user_orders,user_order_starts_at:i "
    "user_mean_days_since_prior,user_median_days_since_prior:d user_total_products,"
    "user_distinct_products:i user_reorder_ratio,user_average_basket,up_order_rate:d up_orders_since_last_order:i "
    "up_order_rate_since_first_order:d last,prev1,prev2:i median,mean,sdev:d reordered,rank_cust:i"
)
RANGE_VALUES = [
    c for item in RANGE_SPEC.split() for c in item.split(":")[0].split(",")
    if c not in ("split", "first_counter", "last_counter", "user_id", "product_id", "rank_cust")
]

# States of a user lie between the days on which any line or order of the user enters or leaves a window or label day.
RANGES_CTES = f"""{rolling_ctes()},
    priors AS (SELECT o.*, date_diff('day', m.d, o.order_date) AS off FROM c_orders o, m WHERE o.eval_set = 'prior'),
    marks AS (SELECT DISTINCT user_id, unnest([0, off - 121, off - 120, off + 1]) AS p
              FROM (SELECT user_id, off FROM dated UNION SELECT user_id, off FROM priors)),
    states AS MATERIALIZED (
        SELECT user_id, p, coalesce(lead(p) OVER (PARTITION BY user_id ORDER BY p), m.last + 16) - 1 AS q
        FROM marks, m WHERE p BETWEEN 0 AND m.last + 15),
    wl AS MATERIALIZED (SELECT t.p, l.* FROM states t JOIN dated l ON l.user_id = t.user_id AND l.off BETWEEN t.p AND t.p + 120),
    hit AS (SELECT DISTINCT t.p, l.user_id, l.product_id FROM states t JOIN dated l ON l.user_id = t.user_id AND l.off = t.p + 121),
    wg AS (SELECT *, row_number() OVER (PARTITION BY p, user_id, product_id ORDER BY order_number DESC) AS gap_no
           FROM (SELECT p, user_id, product_id, order_number, timeline - lag(timeline) OVER
                    (PARTITION BY p, user_id, product_id ORDER BY order_number) AS gap FROM wl)
           WHERE gap IS NOT NULL),
    wgs AS (
        SELECT p, user_id, product_id, max(gap) FILTER (gap_no = 1) AS last, max(gap) FILTER (gap_no = 2) AS prev1,
            max(gap) FILTER (gap_no = 3) AS prev2, median(gap) FILTER (gap_no >= 2) AS median,
            avg(gap) FILTER (gap_no >= 2) AS mean, stddev_pop(gap) FILTER (gap_no >= 2) AS sdev
        FROM wg GROUP BY ALL),
    wup AS (
        SELECT p, user_id, product_id, count(*) AS up_orders, min(order_number) AS up_first_order,
            max(order_number) AS up_last_order, sum(reordered) AS reordered_sum,
            (sum(reordered) + 1.0::DOUBLE) / count(*) AS user_product_reordered_ratio,
            avg(days_since_prior_order) AS days_since_prior_order_mean, median(days_since_prior_order) AS days_since_prior_order_median,
            avg(order_dow) AS order_dow_mean, median(order_dow) AS order_dow_median
        FROM wl GROUP BY ALL),
    wus AS (
        SELECT t.p, o.user_id, max(order_number) AS user_orders, sum(coalesce(days_since_prior_order, 0)) AS user_order_starts_at,
            avg(days_since_prior_order) AS user_mean_days_since_prior, median(days_since_prior_order) AS user_median_days_since_prior
        FROM states t JOIN priors o ON o.user_id = t.user_id AND o.off BETWEEN t.p AND t.p + 120 GROUP BY ALL),
    wbs AS (
        SELECT p, user_id, count(*) AS user_total_products, sum(reordered)::DOUBLE / count(*) AS user_reorder_ratio,
            count(DISTINCT product_id) AS user_distinct_products
        FROM wl WHERE eval_set = 'prior' GROUP BY ALL),
    wide AS MATERIALIZED (
        SELECT u.p, t.q, u.user_id, u.product_id, u.up_orders,
            u.up_first_order, u.up_last_order, u.reordered_sum, {_fill('u', 'days_since_prior_order_mean,days_since_prior_order_median')},
            u.order_dow_mean, u.order_dow_median, u.user_product_reordered_ratio, s.user_orders, s.user_order_starts_at,
            {_fill('s', 'user_mean_days_since_prior,user_median_days_since_prior')},
            b.user_total_products, b.user_distinct_products, b.user_reorder_ratio,
            b.user_total_products::DOUBLE / s.user_orders AS user_average_basket,
            u.up_orders::DOUBLE / s.user_orders AS up_order_rate, s.user_orders - u.up_last_order AS up_orders_since_last_order,
            CASE WHEN s.user_orders - u.up_first_order + 1 = 0 THEN 999
                 ELSE s.user_orders::DOUBLE / (s.user_orders - u.up_first_order + 1) END AS up_order_rate_since_first_order,
            {_fill('g', 'last,prev1,prev2,median,mean,sdev')}, (h.p IS NOT NULL)::INT AS reordered
        FROM wup u JOIN states t ON t.user_id = u.user_id AND t.p = u.p
        JOIN wus s ON s.p = u.p AND s.user_id = u.user_id JOIN wbs b ON b.p = u.p AND b.user_id = u.user_id
        LEFT JOIN hit h ON h.p = u.p AND h.user_id = u.user_id AND h.product_id = u.product_id
        LEFT JOIN wgs g ON g.p = u.p AND g.user_id = u.user_id AND g.product_id = u.product_id),
    ranks AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS rank_cust FROM (SELECT DISTINCT user_id FROM c_orders))"""

ROLLING_SQL = f"""{RANGES_CTES},
    steps AS (
        SELECT *, CASE WHEN lag(q) OVER w + 1 = p AND lag(body) OVER w IS NOT DISTINCT FROM body THEN 0 ELSE 1 END AS fresh
        FROM (SELECT *, row({', '.join(RANGE_VALUES)}) AS body FROM wide) WINDOW w AS (PARTITION BY user_id, product_id ORDER BY p)),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, product_id ORDER BY p) AS island FROM steps),
    each AS (
        SELECT user_id, product_id, min(p) AS lo, max(q) AS hi, {', '.join(f'any_value({c}) AS {c}' for c in RANGE_VALUES)}
        FROM islands GROUP BY user_id, product_id, island);;
    SELECT f.*, c.rank_cust FROM ({CLIPPED.format(rows="each")}) f JOIN ranks c ON c.user_id = f.user_id"""


@query("rolling_features", RANGE_SPEC, ROLLING_SQL)
def rolling_features(spark, sf):
    """Features of pair and user with the label for every daily window, as ranges of windows that share them."""
    return rolling.ranges(load(spark, sf))


TOTALS = "reordered up_orders reordered_sum last prev1 user_orders user_total_products user_distinct_products rank_cust".split() + [
    "prod_orders", "prod_reorders", "prod_users_unq", "prod_users_unq_reordered",
]


@query(
    "rolling_mart_totals",
    f"split:s counter,pairs,{','.join(TOTALS)}:i",
    f"""{RANGES_CTES},
    ups AS (SELECT s, product_id, user_id, count(*) AS n, sum(reordered) AS again FROM held GROUP BY ALL),
    wps AS (
        SELECT s, product_id, sum(n) AS prod_orders, sum(again) AS prod_reorders, count(*) AS prod_users_unq,
            count(*) FILTER (again > 0) AS prod_users_unq_reordered FROM ups GROUP BY ALL),
    days AS (SELECT wide.*, unnest(range(p, q + 1)) AS s FROM wide),
    sums AS (
        SELECT d.s, count(*) AS pairs, {', '.join(f'sum({c}) AS {c}' for c in TOTALS)}
        FROM days d JOIN wps ON wps.s = d.s AND wps.product_id = d.product_id JOIN ranks r ON r.user_id = d.user_id GROUP BY d.s);;
    SELECT split, s - shift AS counter, sums.* EXCLUDE (s) FROM sums, splits, m WHERE s - shift BETWEEN 0 AND m.last""",
)
def rolling_mart_totals(spark, sf):
    """The whole mart of every daily window, row by row with its product's statistics, added up per window."""
    mart = rolling.features(load(spark, sf))
    return mart.groupBy("split", "counter").agg(F.count("*").alias("pairs"), *[F.sum(c).alias(c) for c in TOTALS])
