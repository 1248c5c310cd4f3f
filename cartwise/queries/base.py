"""Sources, sinks, row shaping, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise.operators.joins import lookup_join
from cartwise.operators.scan import dense_ids
from cartwise.plans import candidates, decisions, gaps, marts, splits
from cartwise.registry import query
from cartwise.session import scratch_path
from cartwise.sources import files
from cartwise.sources.baskets import from_csv, from_log, load

FOLDS = 10

ORDER_SPEC = "order_id,user_id:i eval_set:s order_number,order_dow,order_hour_of_day:i days_since_prior_order:d"


@query("canon_orders", ORDER_SPEC, "SELECT * FROM c_orders")
def canon_orders(spark, sf):
    return load(spark, sf).orders


@query(
    "order_lines",
    "order_id,user_id,product_id,add_to_cart_order,reordered,order_number:i eval_set:s "
    "order_dow,order_hour_of_day:i days_since_prior_order:d",
    "SELECT * FROM c_lines",
)
def order_lines(spark, sf):
    return load(spark, sf).lines


@query(
    "product_dim",
    "product_id:i product_name:s aisle_id,department_id:i aisle,department:s lines:i",
    """SELECT p.*, l.lines FROM c_products p
       JOIN (SELECT product_id, count(*) AS lines FROM c_lines GROUP BY product_id) l ON l.product_id = p.product_id""",
)
def product_dim(spark, sf):
    b = load(spark, sf)
    sold = b.lines.groupBy("product_id").agg(F.count("*").alias("lines"))
    return lookup_join(sold, b.products, "product_id")


@query("scan_csv_typed", ORDER_SPEC, "SELECT * FROM c_orders")
def scan_csv_typed(spark, sf):
    path = scratch_path(spark, "orders-csv")
    columns = [item.split()[0] for item in files.ORDERS.split(", ")]
    files.write_csv(load(spark, sf).orders.select(*columns), path)
    return files.read_csv(spark, path, files.ORDERS)


LOG_SPEC = (
    "user_id:i visit_date:s product_id:i units,dollars:d cust_lead_date,cust_prod_lead_date:s "
    "order_id,reordered:i days_since_prior_order,cust_prod_aog:d order_dow:i week_day_name:s "
    "cal_month_nbr:i cal_month_name:s cal_qtr_nbr,cal_year_nbr,cal_week_nbr,rank_cust,train_test:i"
)
LOG_SQL = """
    SELECT user_id, order_date AS visit_date, product_id, units, dollars, cust_lead_date,
        lead(order_date) OVER (PARTITION BY user_id, product_id ORDER BY order_number) AS cust_prod_lead_date,
        order_id, reordered, days_since_prior_order,
        avg(days_since_prior_order) OVER (PARTITION BY user_id, product_id) AS cust_prod_aog,
        order_dow, dayname(order_date) AS week_day_name, month(order_date) AS cal_month_nbr,
        monthname(order_date) AS cal_month_name, quarter(order_date) AS cal_qtr_nbr,
        year(order_date) AS cal_year_nbr, weekofyear(order_date) AS cal_week_nbr, rank_cust, rank_order AS train_test
    FROM c_lines JOIN (SELECT order_id, lead(order_date) OVER (PARTITION BY user_id ORDER BY order_number) AS cust_lead_date,
            dense_rank() OVER (ORDER BY user_id) AS rank_cust FROM c_orders) USING (order_id)"""


@query("scan_log_hive_nulls", LOG_SPEC, LOG_SQL)
def scan_log_hive_nulls(spark, sf):
    b = load(spark, sf)
    path = scratch_path(spark, "log-csv")
    log = splits.purchase_log(b, marts.customer_ranks(b.orders))
    # Unknown gaps are spelled two ways in such logs: as the null marker and as a number.
    gap = F.col("days_since_prior_order")
    spelled = F.when(gap.isNull() & (F.col("order_dow") >= 3), float(files.LOG_UNKNOWN)).otherwise(gap)
    files.write_csv(log.withColumn("days_since_prior_order", spelled), path, header=False, null="\\N")
    return files.read_log(spark, path)


def _basket_csv(spark, sf):
    """The basket tables as a folder of CSV files, in the layout ``from_csv`` reads."""
    b, folder = load(spark, sf), scratch_path(spark, "baskets-csv")

    def put(name: str, frame, schema: str) -> None:
        files.write_csv(frame.select(*[item.split()[0] for item in schema.split(", ")]), f"{folder}/{name}.csv")

    put("orders", b.orders, files.ORDERS)
    put("products", b.products, files.PRODUCTS)
    put("aisles", b.products.select("aisle_id", "aisle").distinct(), files.AISLES)
    put("departments", b.products.select("department_id", "department").distinct(), files.DEPARTMENTS)
    put("order_products__prior", b.prior, files.ORDER_PRODUCTS)
    put("order_products__train", b.lines.filter("eval_set = 'train'"), files.ORDER_PRODUCTS)
    return from_csv(spark, folder)


@query(
    "scan_basket_csv",
    "order_id,user_id,product_id,add_to_cart_order,reordered,order_number,order_size,timeline:i eval_set:s aisle,department:s",
    """SELECT l.*, count(*) OVER (PARTITION BY l.order_id) AS order_size, p.aisle, p.department
       FROM c_lines l JOIN c_products p ON p.product_id = l.product_id WHERE l.eval_set <> 'test'""",
)
def scan_basket_csv(spark, sf):
    b = _basket_csv(spark, sf)
    return lookup_join(b.lines, b.products, "product_id")


@query(
    "csv_training_mart",
    "order_id,product_id,reordered,prod_orders,up_orders:i reorder_prob,up_order_rate,dep_reordered_ratio:d last:i median:d",
    """SELECT l.order_id, l.product_id, l.reordered, ps.prod_orders, r.up_orders, rp.reorder_prob, r.up_order_rate,
        d.dep_reordered::DOUBLE / r.user_orders AS dep_reordered_ratio, coalesce(g.last, 9999) AS last, coalesce(g.median, 9999) AS median
    FROM c_labels l JOIN c_products p ON p.product_id = l.product_id
    JOIN c_product_stat ps ON ps.product_id = l.product_id JOIN c_reorder_prob rp ON rp.product_id = l.product_id
    JOIN c_up_rates r ON r.user_id = l.user_id AND r.product_id = l.product_id
    JOIN c_department_stat d ON d.user_id = l.user_id AND d.department_id = p.department_id
    JOIN c_gap_stats g ON g.user_id = l.user_id AND g.product_id = l.product_id WHERE l.eval_set = 'train'""",
)
def csv_training_mart(spark, sf):
    """The training mart worked out from CSV tables; rows whose truth such tables hold."""
    return marts.training_mart(_basket_csv(spark, sf)).filter("eval_set = 'train'")


@query(
    "log_purchase_gaps",
    "user_id,product_id,order_number,gap,gap_no:i",
    """SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number DESC) AS gap_no
       FROM (SELECT user_id, product_id, order_number,
                days - lag(days) OVER (PARTITION BY user_id, product_id ORDER BY order_number) AS gap
             FROM c_prior JOIN (
                SELECT order_id, sum(coalesce(days_since_prior_order, 0)) OVER (PARTITION BY user_id ORDER BY order_number) AS days
                FROM (SELECT DISTINCT user_id, order_id, order_number, days_since_prior_order FROM c_lines)) USING (order_id))
       WHERE gap IS NOT NULL""",
)
def log_purchase_gaps(spark, sf):
    """Purchase gaps of baskets rebuilt from the purchase log, which has no empty orders."""
    b = load(spark, sf)
    path = scratch_path(spark, "log-csv")
    log = splits.purchase_log(b, marts.customer_ranks(b.orders)).join(
        b.orders.select("order_id", "order_number"), "order_id"
    )
    columns = [item.split()[0] for item in files.PURCHASE_LOG.split(", ")]
    numbered = log.withColumn("order_id", F.col("order_number")).select(*columns)
    files.write_csv(numbered, path, header=False, null="\\N", codec="gzip")
    return gaps.purchase_gaps(from_log(files.read_log(spark, path)).prior)


@query(
    "mart_roundtrip",
    "order_id,user_id,product_id:i eval_set:s reordered:i",
    "SELECT * FROM c_labels",
)
def mart_roundtrip(spark, sf):
    labels = candidates.candidate_labels(load(spark, sf))
    return files.roundtrip(labels, scratch_path(spark, "labels"), ["eval_set"])


@query(
    "sink_submission_csv",
    "order_id:i products:s",
    """SELECT o.order_id, coalesce(string_agg(CAST(s.product_id AS VARCHAR), ' ' ORDER BY s.product_id), 'None') AS products
       FROM c_orders o LEFT JOIN c_scored s ON s.order_id = o.order_id AND s.score > 0.2::DOUBLE
       WHERE o.eval_set = 'test' GROUP BY o.order_id""",
)
def sink_submission_csv(spark, sf):
    path = scratch_path(spark, "submission")
    b = load(spark, sf)
    predicted = decisions.predict(decisions.scored(b), 0.2)
    files.write_csv(decisions.submission(predicted, b.orders.filter(F.col("eval_set") == "test")), path)
    return files.read_csv(spark, path, files.SUBMISSION)


@query(
    "entity_trace",
    "order_id,user_id,order_number,product_id,add_to_cart_order,reordered:i days_since_prior_order:d",
    """SELECT * FROM c_lines WHERE user_id =
       (SELECT user_id FROM c_orders GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)""",
)
def entity_trace(spark, sf):
    """All lines of the busiest user."""
    b = load(spark, sf)
    sizes = b.orders.groupBy("user_id").agg(F.max("user_total_orders").alias("n"))
    busiest = sizes.agg(F.max_by("user_id", F.struct("n", (-F.col("user_id")).alias("low"))).alias("user_id"))
    return b.lines.filter(F.col("user_id") == busiest.scalar())


@query(
    "embedding_columns",
    "product_id:i " + ",".join(f"feature_{i}" for i in range(64)) + ":d",
    "SELECT vec_id AS product_id, "
    + ", ".join(f"embedding[{i + 1}] AS feature_{i}" for i in range(64))
    + " FROM embeddings",
)
def embedding_columns(spark, sf):
    return files.embedding_columns(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query(
    "split_eval_set",
    ORDER_SPEC,
    "SELECT * FROM c_orders WHERE eval_set = 'train' OR eval_set = 'test'",
)
def split_eval_set(spark, sf):
    orders = load(spark, sf).orders
    return orders.filter(F.col("eval_set").isin("train", "test"))


UNIFIED_SPEC = (
    "user_id,order_id,order_number,order_dow,order_hour_of_day:i add_to_cart_order,product_id:n product_name:s "
    "aisle_id,department_id:n days_since_prior_order:d reordered:n eval_set,Flag:s"
)
UNIFIED_SQL = """
    SELECT o.*, t.product_id, t.add_to_cart_order, t.reordered, t."Flag", p.product_name, p.aisle_id, p.department_id
    FROM c_orders o LEFT JOIN (
        SELECT order_id, product_id, add_to_cart_order, reordered, CASE WHEN eval_set = 'prior' THEN 'P' ELSE 'T' END AS "Flag"
        FROM c_lines WHERE eval_set <> 'test'
        UNION ALL SELECT order_id, -1, -1, -1, 'D' FROM c_orders WHERE eval_set = 'test') t ON t.order_id = o.order_id
    LEFT JOIN c_products p ON p.product_id = t.product_id"""


def _unified(spark, sf):
    b = load(spark, sf)
    names = b.products.select("product_id", "product_name", "aisle_id", "department_id")
    return lookup_join(splits.unified_transactions(b), names, "product_id", "left")


@query("unified_transactions", UNIFIED_SPEC, UNIFIED_SQL)
def unified_transactions(spark, sf):
    return _unified(spark, sf)


@query(
    "known_transactions",
    UNIFIED_SPEC,
    f"SELECT * FROM ({UNIFIED_SQL}) WHERE product_id <> -1",
)
def known_transactions(spark, sf):
    return splits.known_lines(_unified(spark, sf))


@query(
    "composite_keys",
    "order_id,product_id:i user_order:s user_product:i",
    """SELECT order_id, product_id, user_id || '_' || order_number AS user_order,
       product_id + user_id * 100000 AS user_product FROM c_lines""",
)
def composite_keys(spark, sf):
    return splits.composite_keys(load(spark, sf).lines)


@query(
    "category_index",
    "p_partkey,name_id,brand_id,type_id:i",
    """SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) AS name_id, dense_rank() OVER (ORDER BY p_brand) AS brand_id,
       dense_rank() OVER (ORDER BY p_type) AS type_id FROM part""",
)
def category_index(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    for column, out in (("p_name", "name_id"), ("p_brand", "brand_id"), ("p_type", "type_id")):
        part = lookup_join(part, dense_ids(part, [column], out), column)
    return part


@query(
    "hash_sample_split",
    "order_id,in_train:i",
    """SELECT order_id, CASE WHEN ((((order_id % 2147483648) * 1103515245 + 12345) % 2147483648) // 65536) % 100 < 75
       THEN 1 ELSE 0 END AS in_train FROM c_orders""",
)
def hash_sample_split(spark, sf):
    return splits.hash_split(load(spark, sf).orders, "order_id")


@query(
    "customer_holdout",
    "user_id,rank_cust:i part:s",
    """SELECT user_id, rank_cust,
              CASE WHEN rank_cust > ceil(max(rank_cust) OVER () * 0.9::DOUBLE) THEN 'test' ELSE 'train' END AS part
       FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) AS rank_cust FROM (SELECT DISTINCT user_id FROM c_orders))""",
)
def customer_holdout(spark, sf):
    return marts.with_holdout(marts.customer_ranks(load(spark, sf).orders))


FOLDS_SQL = f"""
    SELECT order_id, least((rn - 1) // greatest(n // {FOLDS}, 1), {FOLDS - 1}) AS fold
    FROM (SELECT order_id, row_number() OVER (ORDER BY order_id) AS rn, count(*) OVER () AS n
          FROM c_orders WHERE eval_set <> 'prior')"""


@query("order_folds", "order_id,fold:i", FOLDS_SQL)
def order_folds(spark, sf):
    return splits.order_folds(load(spark, sf).target_orders, FOLDS)


@query(
    "fold_members",
    "order_id,product_id,reordered:i",
    f"SELECT * FROM c_labels WHERE order_id IN (SELECT order_id FROM ({FOLDS_SQL}))",
)
def fold_members(spark, sf):
    """Labelled candidates of the orders that fell into a fold."""
    b = load(spark, sf)
    return splits.fold_members(candidates.candidate_labels(b), splits.order_folds(b.target_orders, FOLDS))


@query(
    "label_join",
    "order_id,user_id,product_id,reordered:i",
    "SELECT * FROM c_labels",
)
def label_join(spark, sf):
    b = load(spark, sf)
    return candidates.label_join(candidates.candidates(b), b.target)


@query("candidates", "order_id,user_id,product_id:i eval_set:s", "SELECT * FROM c_candidates")
def candidate_pairs(spark, sf):
    return candidates.candidates(load(spark, sf))


@query("candidate_labels", "order_id,user_id,product_id,reordered:i eval_set:s", "SELECT * FROM c_labels")
def candidate_labels(spark, sf):
    return candidates.candidate_labels(load(spark, sf))


@query("previous_products", "user_id,product_id:i", "SELECT DISTINCT user_id, product_id FROM c_prior")
def previous_products(spark, sf):
    return candidates.previous_products(load(spark, sf).prior)


@query(
    "eval_flagged_prior",
    "user_id,order_id,product_id:i Flag:s",
    """SELECT p.user_id, p.order_id, p.product_id, CASE WHEN o.eval_set = 'test' THEN 'Test' ELSE 'Train' END AS "Flag"
       FROM c_prior p JOIN c_orders o ON o.user_id = p.user_id AND o.eval_set <> 'prior'""",
)
def eval_flagged_prior(spark, sf):
    b = load(spark, sf)
    return lookup_join(b.prior, splits.eval_map(b.orders), "user_id")


@query(
    "calendar_attributes",
    "event_id,hour,order_dow:i week_day_name:s cal_month_nbr:i cal_month_name:s cal_qtr_nbr,cal_year_nbr,cal_week_nbr:i",
    """SELECT event_id, hour(ts) AS hour, dayofweek(ts) AS order_dow, dayname(ts) AS week_day_name,
       month(ts) AS cal_month_nbr, monthname(ts) AS cal_month_name, quarter(ts) AS cal_qtr_nbr,
       year(ts) AS cal_year_nbr, weekofyear(ts) AS cal_week_nbr FROM events""",
)
def calendar_attributes(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.withColumns({"hour": F.hour("ts")} | splits.calendar(F.col("ts")))


@query(
    "basket_overlap",
    "user_id,order_id,order_number,shared,basket:i",
    """SELECT a.user_id, a.order_id, a.order_number, count(b.product_id) AS shared, count(*) AS basket
       FROM c_lines a LEFT JOIN c_lines b
       ON b.user_id = a.user_id AND b.product_id = a.product_id AND b.order_number = a.order_number - 1
       GROUP BY a.user_id, a.order_id, a.order_number""",
)
def basket_overlap(spark, sf):
    """Products an order shares with the order before it, as an array intersection."""
    lines = load(spark, sf).lines
    baskets = lines.groupBy("user_id", "order_id", "order_number").agg(F.collect_set("product_id").alias("products"))
    before = baskets.select(
        "user_id", (F.col("order_number") + 1).alias("order_number"), F.col("products").alias("earlier")
    )
    none = F.array().cast("array<bigint>")
    return baskets.join(before, ["user_id", "order_number"], "left").select(
        "user_id",
        "order_id",
        "order_number",
        F.size(F.array_intersect("products", F.coalesce("earlier", none))).alias("shared"),
        F.size("products").alias("basket"),
    )
