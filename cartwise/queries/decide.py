"""Thresholds, baskets and quality measures on a repeatable score."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise.plans import decisions, marts, metrics
from cartwise.queries.marts import SIZE_SQL
from cartwise.registry import query
from cartwise.sources.baskets import TEST, load


def _scored(spark, sf):
    return decisions.scored(load(spark, sf))


@query(
    "threshold_predictions",
    "order_id,product_id:i score:d "
    + ",".join(f"over_{i}" for i in range(len(decisions.THRESHOLDS)))
    + ":i",
    "SELECT order_id, product_id, score, "
    + ", ".join(f"CASE WHEN score > {t}::DOUBLE THEN 1 ELSE 0 END AS over_{i}" for i, t in enumerate(decisions.THRESHOLDS))
    + " FROM c_scored",
)
def threshold_predictions(spark, sf):
    rows = _scored(spark, sf)
    return rows.withColumns(
        {f"over_{i}": (F.col("score") > t).cast("int") for i, t in enumerate(decisions.THRESHOLDS)}
    )


@query(
    "blend_predictions",
    "order_id,product_id:i score:d predicted:i",
    """SELECT order_id, product_id, 0.5::DOUBLE * score + 0.5::DOUBLE * score2 AS score,
       CASE WHEN 0.5::DOUBLE * score + 0.5::DOUBLE * score2 > 0.205::DOUBLE THEN 1 ELSE 0 END AS predicted FROM c_scored""",
)
def blend_predictions(spark, sf):
    rows = _scored(spark, sf)
    second = rows.select("order_id", "product_id", F.col("score2").alias("score"))
    return decisions.predict(decisions.blend(rows, second), 0.205)


@query(
    "submission_with_none",
    "order_id:i products:s",
    """SELECT order_id, string_agg(CAST(product_id AS VARCHAR), ' ' ORDER BY product_id) AS products
       FROM c_scored WHERE score > 0.2::DOUBLE
         AND order_id IN (SELECT order_id FROM c_orders WHERE eval_set = 'test') GROUP BY order_id
       UNION ALL
       SELECT order_id, 'None' FROM c_orders
       WHERE eval_set = 'test' AND order_id NOT IN (SELECT order_id FROM c_scored WHERE score > 0.2::DOUBLE)""",
)
def submission_with_none(spark, sf):
    """One row per order of the test set."""
    b = load(spark, sf)
    return decisions.submission(decisions.predict(decisions.scored(b), 0.2), b.orders.filter(F.col("eval_set") == TEST))


@query(
    "none_probability",
    "order_id:i p_none:d",
    "SELECT order_id, product(1.0::DOUBLE - score) AS p_none FROM c_scored GROUP BY order_id",
)
def none_probability(spark, sf):
    return decisions.none_probability(_scored(spark, sf))


@query(
    "top_k_candidates",
    "order_id,product_id,rn:i score:d",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY score DESC, product_id) AS rn FROM c_scored)
       WHERE rn <= 80""",
)
def top_k_candidates(spark, sf):
    return decisions.top_candidates(_scored(spark, sf))


@query(
    "score_rank",
    "user_id,product_id,rank:i score:d",
    "SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY score DESC) AS rank FROM c_scored",
)
def score_rank(spark, sf):
    return decisions.score_rank(_scored(spark, sf))


def f1_ctes(source: str) -> str:
    """Expected F1 by recurrences over k: counts within the top k, and inverse sizes of the rest."""
    return f"""RECURSIVE
    groups AS MATERIALIZED (
        SELECT order_id, list(score ORDER BY score DESC, product_id) AS p, list(product_id ORDER BY score DESC, product_id) AS ids,
            count(*) AS n, product(1.0::DOUBLE - score) AS p_none FROM {source} GROUP BY order_id),
    heads(order_id, k, c) AS (
        SELECT order_id, 0, [1.0::DOUBLE] FROM groups
        UNION ALL
        SELECT h.order_id, h.k + 1, [ (CASE WHEN j <= h.k + 1 THEN h.c[j] * (1 - g.p[h.k + 1]) ELSE 0 END)
            + (CASE WHEN j > 1 THEN h.c[j - 1] * g.p[h.k + 1] ELSE 0 END) for j in range(1, h.k + 3)]
        FROM heads h JOIN groups g ON g.order_id = h.order_id WHERE h.k < g.n),
    tails(order_id, k, s) AS (
        SELECT order_id, n, [1.0::DOUBLE / i for i in range(1, 2 * n + 3)] FROM groups
        UNION ALL
        SELECT t.order_id, t.k - 1, [(1 - g.p[t.k]) * t.s[i] + g.p[t.k] * t.s[i + 1] for i in range(1, len(t.s))]
        FROM tails t JOIN groups g ON g.order_id = t.order_id WHERE t.k > 0),
    expected AS MATERIALIZED (
        SELECT h.order_id, h.k,
            list_sum([CASE WHEN j = 0 THEN 0 ELSE 2 * j * h.c[j + 1] * t.s[h.k + j] END for j in range(0, h.k + 1)]) AS plain,
            list_sum([2 * j * h.c[j + 1] * t.s[h.k + j + 1] for j in range(0, h.k + 1)]) + 2 * g.p_none / (2 + h.k) AS with_none
        FROM heads h JOIN tails t ON t.order_id = h.order_id AND t.k = h.k JOIN groups g ON g.order_id = h.order_id)"""


F1_NONE = (
    f1_ctes("c_scored")
    + """;;SELECT g.order_id, g.ids, b.k AS k_max, b.none = 0 AS pred_none, b.e AS ef1
    FROM groups g JOIN (
        SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY round(e, 12) DESC, none, k) AS rn
        FROM (SELECT order_id, k, 0 AS none, with_none AS e FROM expected UNION ALL SELECT order_id, k, 1, plain FROM expected)) b
    ON b.order_id = g.order_id AND b.rn = 1"""
)
F1_PLAIN = (
    f1_ctes("c_scored")
    + """;;SELECT order_id, k AS k_max, false AS pred_none, plain AS ef1
    FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY round(plain, 12) DESC, k) AS rn FROM expected) WHERE rn = 1"""
)


@query("f1_optimal_k", "order_id,k_max,pred_none:i ef1:d", F1_NONE)
def f1_optimal_k(spark, sf):
    return decisions.optimal_k(_scored(spark, sf))


@query("f1_optimal_k_no_none", "order_id,k_max,pred_none:i ef1:d", F1_PLAIN)
def f1_optimal_k_no_none(spark, sf):
    return decisions.optimal_k(_scored(spark, sf), allow_none=False)


WITH_NONE = (
    "(SELECT order_id, product_id, score FROM c_scored UNION ALL "
    "SELECT order_id, 0, product(1.0::DOUBLE - score) FROM c_scored GROUP BY order_id)"
)


@query("f1_optimal_k_none_candidate", "order_id,k_max,pred_none:i ef1:d", F1_PLAIN.replace("c_scored", WITH_NONE, 1))
def f1_optimal_k_none_candidate(spark, sf):
    """The search without "None", with "None" as one more candidate."""
    return decisions.optimal_k(decisions.with_none_candidate(_scored(spark, sf)), allow_none=False)


@query(
    "f1_baskets",
    "order_id,k_max,pred_none:i products:s",
    F1_NONE.replace(
        "SELECT g.order_id, g.ids,",
        "SELECT g.order_id, array_to_string(list_concat(CASE WHEN b.none = 0 THEN ['None'] ELSE CAST([] AS VARCHAR[]) END, "
        "CAST(g.ids[1:b.k] AS VARCHAR[])), ' ') AS products,",
    ),
)
def f1_baskets(spark, sf):
    return decisions.baskets(_scored(spark, sf))


CONFUSION = """(SELECT count(*) FILTER (reordered = 1 AND score > 0.2::DOUBLE) AS tp,
    count(*) FILTER (reordered = 0 AND score > 0.2::DOUBLE) AS fp, count(*) FILTER (reordered = 1 AND NOT score > 0.2::DOUBLE) AS fn,
    count(*) FILTER (reordered = 0 AND NOT score > 0.2::DOUBLE) AS tn FROM c_scored)"""


@query(
    "fbeta_metric",
    "beta:d tp,fp,fn:i f:d",
    f"""SELECT beta, tp, fp, fn, (1 + beta * beta) * tp / ((1 + beta * beta) * tp + fp + beta * beta * fn) AS f
        FROM {CONFUSION} c, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) b(beta)""",
)
def fbeta_metric(spark, sf):
    return metrics.fbeta_table(decisions.predict(_scored(spark, sf), 0.2))


@query(
    "mean_f1_by_threshold",
    "threshold,mean_f1:d",
    f"""SELECT threshold, avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END) AS mean_f1
        FROM (SELECT threshold, order_id, count(*) FILTER (reordered = 1 AND score > threshold) AS tp,
                count(*) FILTER (reordered = 0 AND score > threshold) AS fp,
                count(*) FILTER (reordered = 1 AND NOT score > threshold) AS fn
              FROM c_scored, (VALUES {', '.join(f'({t}::DOUBLE)' for t in decisions.THRESHOLDS)}) t(threshold)
              GROUP BY threshold, order_id) GROUP BY threshold""",
)
def mean_f1_by_threshold(spark, sf):
    return metrics.mean_f1(_scored(spark, sf), decisions.THRESHOLDS)


@query(
    "class_report",
    "label:i precision,recall,fscore:d support:i",
    f"""SELECT 1 AS label, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall,
            2.0::DOUBLE * tp / (2 * tp + fp + fn) AS fscore, tp + fn AS support FROM {CONFUSION}
        UNION ALL SELECT 0, tn::DOUBLE / (tn + fn), tn::DOUBLE / (tn + fp), 2.0::DOUBLE * tn / (2 * tn + fp + fn), tn + fp
        FROM {CONFUSION}""",
)
def class_report(spark, sf):
    return metrics.class_report(decisions.predict(_scored(spark, sf), 0.2))


@query(
    "log_loss_metric",
    "log_loss:d",
    """SELECT avg(-(reordered * ln(p) + (1 - reordered) * ln(1 - p))) AS log_loss
       FROM (SELECT reordered, least(greatest(score, 1e-15::DOUBLE), 1.0::DOUBLE - 1e-15::DOUBLE) AS p FROM c_scored)""",
)
def log_loss_metric(spark, sf):
    return metrics.log_loss(_scored(spark, sf))


@query(
    "mape_metric",
    "mape:d",
    SIZE_SQL.replace(";;", ";;SELECT avg(abs(dep - avg_bask_lag) / dep * 100) AS mape FROM (", 1) + ") WHERE part = 'train'",
)
def mape_metric(spark, sf):
    """Error of the mean of the three newest baskets as a forecast of the next one."""
    mart = marts.basket_size_mart(marts.order_profile(load(spark, sf)))
    return metrics.mape(mart.filter("part = 'train'"), "dep", "avg_bask_lag")
