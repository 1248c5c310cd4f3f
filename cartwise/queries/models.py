"""Fitted models.

What a model predicts has no SQL form. SQL says which rows there have to be, how many of them, and that the
predictions keep their bounds; each bound is worked out by Spark from the predictions themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise.plans import decisions, marts, models
from cartwise.registry import query
from cartwise.session import materialize
from cartwise.sources.baskets import load

_FITTED: dict[tuple[str, str, str], tuple] = {}


def _once(kind, spark, sf, make):
    """A mart and its fitted model, shared by the queries of a session."""
    key = (kind, spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _mart(spark, sf):
    return _once("mart", spark, sf, lambda: materialize(marts.training_mart(load(spark, sf))))


def _classifier(spark, sf):
    mart = _mart(spark, sf)
    train = mart.filter("eval_set = 'train'")
    return mart, _once("classifier", spark, sf, lambda: models.fit_classifier(train, marts.FEATURES))


def _scores(spark, sf):
    mart, model = _classifier(spark, sf)
    return models.classify(model, mart.filter("eval_set = 'test'"), marts.FEATURES)


@query("gbt_scores", "order_id,user_id,product_id:i score:d")
def gbt_scores(spark, sf):
    """Purchase probability of every candidate of the orders to be scored."""
    return _scores(spark, sf)


@query(
    "gbt_score_bounds",
    "order_id,user_id,product_id,probable:i",
    "SELECT order_id, user_id, product_id, 1 AS probable FROM c_labels WHERE eval_set = 'test'",
)
def gbt_score_bounds(spark, sf):
    """The same candidates with 1 where the score is a probability."""
    return _scores(spark, sf).withColumn("probable", F.col("score").between(0, 1).cast("int"))


BUCKET = """(floor((order_id % 2147483648 * 1103515245::HUGEINT + 12345) % 2147483648 / 65536)::BIGINT % 100)"""


@query(
    "gbt_fit_report",
    "part:s candidates,positives,rounds_fit,learnt:i",
    f"""SELECT CASE WHEN {BUCKET} < 75 THEN 'grown' ELSE 'validation' END AS part, count(*) AS candidates,
        sum(reordered) AS positives, 1 AS rounds_fit, 1 AS learnt
    FROM c_labels WHERE eval_set = 'train' GROUP BY 1""",
)
def gbt_fit_report(spark, sf):
    """Both training parts, with 1 where the rounds lie within their number and the loss below that of a fair coin."""
    mart, model = _classifier(spark, sf)
    report = models.fit_report(model, mart.filter("eval_set = 'train'"), marts.FEATURES)
    return report.withColumns(
        {
            "rounds_fit": F.col("rounds").between(1, 100).cast("int"),
            "learnt": (F.col("log_loss") < F.ln(F.lit(2.0))).cast("int"),
        }
    )


@query("gbt_submission", "order_id:i products:s")
def gbt_submission(spark, sf):
    """From the mart over the fitted model and a threshold to one row per order of the test set."""
    orders = load(spark, sf).orders.filter("eval_set = 'test'")
    return decisions.submission(decisions.predict(_scores(spark, sf), 0.205), orders)


@query("gbt_submission_orders", "order_id:i", "SELECT order_id FROM c_orders WHERE eval_set = 'test'")
def gbt_submission_orders(spark, sf):
    return gbt_submission(spark, sf)


@query("gbt_f1_baskets", "order_id:i", "SELECT DISTINCT order_id FROM c_labels WHERE eval_set = 'test'")
def gbt_f1_baskets(spark, sf):
    """Baskets of best expected F1 on the fitted scores: one per order with candidates."""
    return decisions.baskets(_scores(spark, sf))


@query("gbt_feature_importance", "feature:s importance:d")
def gbt_feature_importance(spark, sf):
    _, model = _classifier(spark, sf)
    return models.feature_importance(spark, model, marts.FEATURES)


def _sizes(spark, sf):
    return _once("sizes", spark, sf, lambda: materialize(marts.basket_size_mart(marts.order_profile(load(spark, sf)))))


def _size_model(spark, sf):
    mart = _sizes(spark, sf)
    return mart, _once("size model", spark, sf, lambda: models.fit_sizes(mart))


@query("basket_size_model", "user_id:i Segment:s predicted:d")
def basket_size_model(spark, sf):
    mart, model = _size_model(spark, sf)
    return models.predict_sizes(model, mart)


@query(
    "basket_size_mape",
    "users:i guess_mape:d better:i",
    """c_size_profile AS (
        SELECT p.user_id, p.rank_order, p.n FROM (
            SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY order_number DESC) AS rank_order, n
            FROM (SELECT user_id, order_number, count(*) AS n FROM c_prior GROUP BY ALL)) p
        JOIN c_orders o ON o.user_id = p.user_id AND o.eval_set = 'test');;
    SELECT count(*) AS users, avg(abs(d.n - g.guess) / d.n) * 100 AS guess_mape, 1 AS better
    FROM c_size_profile d
    JOIN (SELECT user_id, avg(n) AS guess FROM c_size_profile WHERE rank_order BETWEEN 2 AND 4 GROUP BY user_id) g
        ON g.user_id = d.user_id
    WHERE d.rank_order = 1""",
)
def basket_size_mape(spark, sf):
    """Error of guessing the mean of the last baskets, and 1 where the fitted model's error is below it."""
    mart, model = _size_model(spark, sf)
    errors = models.size_errors(model, mart)

    def mape(guess):
        return F.avg(F.abs(F.col("actual") - F.col(guess)) / F.col("actual")) * 100

    return errors.agg(
        F.count("*").alias("users"),
        mape("avg_bask_lag").alias("guess_mape"),
        (mape("predicted") < mape("avg_bask_lag")).cast("int").alias("better"),
    )


def _fold_sql(folds: int, orders: str, rows: str) -> str:
    """Rows per contiguous fold of the sorted order ids; the last fold takes the remainder."""
    return f"""fold_orders AS (
        SELECT order_id, least((row_number() OVER (ORDER BY order_id) - 1) // greatest(count(*) OVER () // {folds}, 1), {folds} - 1) AS fold
        FROM ({orders}));;
    SELECT fold, count(*) AS examples, 1 AS rounds_fit, 1 AS scored
    FROM fold_orders f JOIN ({rows}) r ON r.order_id = f.order_id GROUP BY fold"""


def _fold_report(scores, most_rounds: int, most_score: float):
    """Folds with 1 where the rounds lie within their number and the score within its range."""
    return scores.withColumns(
        {
            "rounds_fit": F.col("rounds").between(1, most_rounds).cast("int"),
            "scored": F.col("score").between(0, most_score).cast("int"),
        }
    )


@query(
    "cv_classifier",
    "fold,examples,rounds_fit,scored:i",
    _fold_sql(
        5,
        "SELECT DISTINCT order_id FROM c_labels WHERE eval_set = 'train'",
        "SELECT order_id FROM c_labels WHERE eval_set = 'train'",
    ),
)
def cv_classifier(spark, sf):
    """Five folds of orders: candidates, rounds and area under the curve of each."""
    train = _mart(spark, sf).filter("eval_set = 'train'")
    return _fold_report(models.cross_validate_classifier(train, marts.FEATURES), 5, 1.0)


SIZE_ROWS = """SELECT o.order_id FROM c_orders o
    JOIN (SELECT user_id FROM c_prior GROUP BY user_id HAVING count(DISTINCT order_number) >= 2) u ON u.user_id = o.user_id
    WHERE o.eval_set = 'test'"""


@query("cv_scores", "fold,examples,rounds_fit,scored:i", _fold_sql(10, SIZE_ROWS, SIZE_ROWS))
def cv_scores(spark, sf):
    """Ten folds of target orders: users, rounds and error of the log basket size of each."""
    scores = models.cross_validate_sizes(_sizes(spark, sf), load(spark, sf).target_orders)
    return _fold_report(scores, 500, 5.0)


def _pairs(spark, sf):
    return models.skip_gram_pairs(load(spark, sf).lines)


@query(
    "skip_gram_pairs",
    "part:s product_id,context_id,pairs:i",
    f"""SELECT CASE WHEN {BUCKET.replace('order_id', 'a.order_id')} < 10 THEN 'holdout' ELSE 'train' END AS part,
        a.product_id, b.product_id AS context_id, count(*) AS pairs
    FROM c_lines a JOIN c_lines b ON b.order_id = a.order_id AND abs(a.add_to_cart_order - b.add_to_cart_order) = 1
    GROUP BY 1, 2, 3""",
)
def skip_gram_pairs(spark, sf):
    """Neighbours in the cart, a tenth of the baskets apart."""
    return _pairs(spark, sf)


def _vectors(spark, sf, held):
    """Vectors of all baskets, or of those outside the holdout."""

    def make():
        baskets = models.sentences(load(spark, sf).lines)
        return materialize(models.product_embeddings(materialize(baskets.filter(~models.held_basket()) if held else baskets)))

    return _once(f"vectors {held}", spark, sf, make)


@query("product_embeddings", "product_id,width:i norm:d embedding:a")
def product_embeddings(spark, sf):
    vectors = _vectors(spark, sf, False)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, v: total + v * v))
    return vectors.select("product_id", F.size("embedding").alias("width"), norm.alias("norm"), "embedding")


@query(
    "embedding_vocabulary",
    "product_id,width:i",
    "SELECT product_id, 100 AS width FROM c_lines GROUP BY product_id HAVING count(*) >= 2",
)
def embedding_vocabulary(spark, sf):
    """Products that have a vector, and its length."""
    return _vectors(spark, sf, False).select("product_id", F.size("embedding").alias("width"))


@query(
    "embedding_holdout",
    "pairs,cosine_fits:i",
    f"""known AS (SELECT product_id FROM c_lines WHERE {BUCKET} >= 10 GROUP BY product_id HAVING count(*) >= 2);;
    SELECT count(*) AS pairs, 1 AS cosine_fits
    FROM c_lines a JOIN c_lines b ON b.order_id = a.order_id AND abs(a.add_to_cart_order - b.add_to_cart_order) = 1
    WHERE {BUCKET.replace('order_id', 'a.order_id')} < 10
        AND a.product_id IN (SELECT product_id FROM known) AND b.product_id IN (SELECT product_id FROM known)""",
)
def embedding_holdout(spark, sf):
    """Held-out neighbours whose products both have a vector trained on the other baskets."""
    found = models.holdout_similarity(_vectors(spark, sf, True), _pairs(spark, sf))
    return found.withColumn("cosine_fits", F.col("mean_cosine").between(-1, 1).cast("int"))


@query("embedding_pca", "vec_id:i component_1,component_2:d")
def embedding_pca(spark, sf):
    return models.project(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id")
