"""SQL views of the basket model, in the dialect of the checking database.

A query text names the views it needs as ``c_…``; the views it reaches are put before it.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "c_orders": """
        SELECT *, sum(coalesce(days_since_prior_order, 0)) OVER (PARTITION BY user_id ORDER BY order_number) AS timeline
        FROM (
            SELECT *, user_total_orders - order_number + 1 AS rank_order,
                date_diff('day', prior_date, order_date) AS days_since_prior_order,
                dayofweek(order_date) AS order_dow, order_id % 24 AS order_hour_of_day,
                CASE WHEN order_number < user_total_orders THEN 'prior'
                     WHEN user_id % 3 = 0 THEN 'test' ELSE 'train' END AS eval_set
            FROM (
                SELECT o_orderkey AS order_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS order_date,
                    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS order_number,
                    count(*) OVER (PARTITION BY o_custkey) AS user_total_orders,
                    lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior_date
                FROM orders))""",
    "c_products": """
        SELECT p_brand AS aisle, p_type AS department, product_name,
            dense_rank() OVER (ORDER BY p_brand, p_type) AS product_id,
            dense_rank() OVER (ORDER BY p_brand) AS aisle_id,
            dense_rank() OVER (ORDER BY p_type) AS department_id
        FROM (SELECT p_brand, p_type, min(p_name) AS product_name FROM part GROUP BY p_brand, p_type)""",
    "c_lines": """
        SELECT l.*, o.* EXCLUDE (order_id),
            CASE WHEN o.order_number > min(o.order_number) OVER (PARTITION BY o.user_id, l.product_id)
                 THEN 1 ELSE 0 END AS reordered
        FROM (
            SELECT order_id, product_id, units, dollars,
                row_number() OVER (PARTITION BY order_id ORDER BY line, product_id) AS add_to_cart_order
            FROM (
                SELECT l_orderkey AS order_id, c.product_id, min(l_linenumber) AS line,
                    sum(l_quantity) AS units, sum(l_extendedprice) AS dollars
                FROM lineitem JOIN part ON l_partkey = p_partkey
                JOIN c_products c ON c.aisle = p_brand AND c.department = p_type
                GROUP BY l_orderkey, c.product_id)) l
        JOIN c_orders o ON o.order_id = l.order_id""",
    "c_prior": "SELECT * FROM c_lines WHERE eval_set = 'prior'",
    "c_target": "SELECT * FROM c_lines WHERE eval_set <> 'prior'",
    "c_sized": """
        SELECT *, order_size - add_to_cart_order AS add_to_cart_order_inverted,
            add_to_cart_order * 1.0::DOUBLE / order_size AS add_to_cart_order_relative
        FROM (SELECT *, count(*) OVER (PARTITION BY order_id) AS order_size FROM c_prior)""",
    "c_product_stat": """
        SELECT product_id, count(*) AS prod_orders, sum(reordered) AS prod_reorders,
            avg(add_to_cart_order) AS prod_add_to_card_mean,
            sum(reordered)::DOUBLE / count(*) AS reorder_ration
        FROM c_prior GROUP BY product_id""",
    "c_reach": """
        SELECT product_id, count(DISTINCT user_id) AS prod_users_unq,
            count(DISTINCT CASE WHEN reordered = 1 THEN user_id END) AS prod_users_unq_reordered
        FROM c_prior GROUP BY product_id""",
    "c_reorder_prob": """
        SELECT product_id, avg(ever) AS reorder_prob
        FROM (SELECT product_id, user_id, CASE WHEN sum(reordered) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ever
              FROM c_prior GROUP BY product_id, user_id)
        GROUP BY product_id""",
    "c_user_stat": """
        SELECT user_id, max(order_number) AS user_orders,
            sum(coalesce(days_since_prior_order, 0)) AS user_order_starts_at,
            avg(days_since_prior_order) AS user_mean_days_since_prior,
            median(days_since_prior_order) AS user_median_days_since_prior
        FROM c_orders WHERE eval_set = 'prior' GROUP BY user_id""",
    "c_basket_stat": """
        SELECT p.user_id, count(*) AS user_total_products,
            sum(reordered)::DOUBLE / count(*) AS user_reorder_ratio,
            count(DISTINCT product_id) AS user_distinct_products,
            count(*)::DOUBLE / any_value(s.user_orders) AS user_average_basket
        FROM c_prior p JOIN c_user_stat s ON s.user_id = p.user_id GROUP BY p.user_id""",
    "c_up_stat": """
        SELECT user_id, product_id, count(*) AS up_orders, min(order_number) AS up_first_order,
            max(order_number) AS up_last_order,
            avg(add_to_cart_order) AS up_mean_cart_position, median(add_to_cart_order) AS up_median_cart_position,
            avg(days_since_prior_order) AS days_since_prior_order_mean,
            median(days_since_prior_order) AS days_since_prior_order_median,
            avg(order_dow) AS order_dow_mean, median(order_dow) AS order_dow_median,
            avg(order_hour_of_day) AS order_hour_of_day_mean, median(order_hour_of_day) AS order_hour_of_day_median,
            avg(add_to_cart_order_inverted) AS add_to_cart_order_inverted_mean,
            median(add_to_cart_order_inverted) AS add_to_cart_order_inverted_median,
            avg(add_to_cart_order_relative) AS add_to_cart_order_relative_mean,
            median(add_to_cart_order_relative) AS add_to_cart_order_relative_median,
            sum(reordered) AS reordered_sum,
            (sum(reordered) + 1.0::DOUBLE) / count(*) AS user_product_reordered_ratio
        FROM c_sized GROUP BY user_id, product_id""",
    "c_up_rates": """
        SELECT u.user_id, u.product_id, u.up_orders, u.up_first_order, u.up_last_order, s.user_orders,
            u.reordered_sum, u.user_product_reordered_ratio,
            u.up_orders::DOUBLE / s.user_orders AS up_order_rate,
            s.user_orders - u.up_last_order AS up_orders_since_last_order,
            s.user_orders::DOUBLE / (s.user_orders - u.up_first_order + 1) AS up_order_rate_since_first_order,
            u.up_orders::DOUBLE / (s.user_orders - u.up_first_order + 1) AS up_orders_per_order_since_first
        FROM c_up_stat u JOIN c_user_stat s ON s.user_id = u.user_id""",
    "c_department_stat": """
        SELECT user_id, department_id, count(DISTINCT l.product_id) AS dep_products, sum(reordered) AS dep_reordered
        FROM c_prior l JOIN c_products p ON p.product_id = l.product_id GROUP BY user_id, department_id""",
    "c_aisle_stat": """
        SELECT user_id, aisle_id, count(DISTINCT l.product_id) AS aisle_products, sum(reordered) AS aisle_reordered
        FROM c_prior l JOIN c_products p ON p.product_id = l.product_id GROUP BY user_id, aisle_id""",
    "c_gaps": """
        SELECT user_id, product_id, order_number, gap,
            row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number DESC) AS gap_no
        FROM (SELECT user_id, product_id, order_number,
                timeline - lag(timeline) OVER (PARTITION BY user_id, product_id ORDER BY order_number) AS gap
              FROM c_prior)
        WHERE gap IS NOT NULL""",
    "c_gaps_target": """
        SELECT user_id, product_id, order_number, gap,
            row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number DESC) AS gap_no
        FROM (SELECT user_id, product_id, order_number,
                timeline - lag(timeline) OVER (PARTITION BY user_id, product_id ORDER BY order_number) AS gap
              FROM c_lines)
        WHERE gap IS NOT NULL""",
    "c_gap_stats": """
        SELECT p.user_id, p.product_id, max(gap) FILTER (gap_no = 1) AS last, max(gap) FILTER (gap_no = 2) AS prev1,
            max(gap) FILTER (gap_no = 3) AS prev2, median(gap) FILTER (gap_no >= 2) AS median,
            avg(gap) FILTER (gap_no >= 2) AS mean, stddev_pop(gap) FILTER (gap_no >= 2) AS sdev
        FROM (SELECT DISTINCT user_id, product_id FROM c_prior) p
        LEFT JOIN c_gaps g ON g.user_id = p.user_id AND g.product_id = p.product_id
        GROUP BY p.user_id, p.product_id""",
    "c_candidates": """
        SELECT o.order_id, o.user_id, c.product_id, o.eval_set
        FROM (SELECT DISTINCT user_id, product_id FROM c_prior) c
        JOIN c_orders o ON o.user_id = c.user_id AND o.eval_set <> 'prior'""",
    "c_labels": """
        SELECT c.*, CASE WHEN t.product_id IS NULL THEN 0 ELSE 1 END AS reordered
        FROM c_candidates c LEFT JOIN c_target t ON t.order_id = c.order_id AND t.product_id = c.product_id""",
    "c_scored": """
        SELECT l.order_id, l.user_id, l.product_id, l.reordered, r.up_order_rate AS score,
            r.up_orders_per_order_since_first AS score2
        FROM c_labels l JOIN c_up_rates r ON r.user_id = l.user_id AND r.product_id = l.product_id""",
}


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"\bc_\w+", text):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen.append(name)
    return seen


def with_views(sql: str, picked: str) -> str:
    """Whole query text: the views in use, then ``sql`` shaped to the picked columns."""
    recursive = sql.lstrip().startswith("RECURSIVE")
    body = sql.lstrip().removeprefix("RECURSIVE")
    views = _needed(sql, [])
    heads = [f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in views]
    if ";;" in body:
        ctes, body = body.split(";;")
        heads.append(ctes)
    start = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(heads) + "\n" if heads else ""
    return f"{start}SELECT {picked} FROM ({body}) AS result"
