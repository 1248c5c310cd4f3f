"""Fitted models on the feature marts, with Spark ML.

Boosting stops early: a part of the training rows, chosen by the hash of an id, is held out
(``validationIndicatorCol``), and no tree is added once the loss on it stops falling by ``TOLERANCE``. The
number of rounds in the arguments is the most there may be; ``rounds_used`` tells how many there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from cartwise.functions.columns import id_bucket, log_loss_term
from cartwise.plans.splits import hash_split, order_folds
from cartwise.session import materialize

SEED = 42
#: Least relative fall of the validation loss from round to round.
TOLERANCE = 0.001
#: Percentage of the training rows that trees are grown on; the others decide when to stop.
GROWN_ON = 75
#: Rows of a stored file, and of a task when folds are fitted: a round of a small model is many jobs, each as short as
#: its few tasks, and a round of a large one takes as long as its largest task.
FOLD_ROWS = 50_000
#: Bytes of word vectors that the trainer may hold on the driver.
MOST_VECTOR_BYTES = 1 << 30


def with_validation(rows: DataFrame, id_column: str) -> DataFrame:
    """Mark rows with ``held`` where their id falls into the validation part."""
    return hash_split(rows, id_column, GROWN_ON).withColumn("held", F.col("in_train") == 0).drop("in_train")


def classifier(
    features: Sequence[str],
    label: str = "reordered",
    rounds: int = 100,
    depth: int = 8,
    rate: float = 0.05,
    subsample: float = 0.86,
    columns: float = 0.85,
    least_rows: int = 10,
    validated: bool = True,
) -> Pipeline:
    """Boosted trees for a 0/1 label over plain number columns.

    ``columns`` is the share of features tried at a split, ``least_rows`` the rows a leaf has at least. With
    ``validated`` the training rows carry ``held``.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    trees = GBTClassifier(
        labelCol=label,
        maxIter=rounds,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=subsample,
        featureSubsetStrategy=str(columns),
        minInstancesPerNode=least_rows,
        seed=SEED,
    )
    if validated:
        trees.setValidationIndicatorCol("held").setParams(validationTol=TOLERANCE)
    return Pipeline(stages=[assembler, trees])


def _numbers(rows: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """Missing features count zero; the label becomes a double."""
    filled = rows.fillna(0, subset=list(features))
    return filled if label is None else filled.withColumn(label, F.col(label).cast("double"))


def vectors(rows: DataFrame, features: Sequence[str], *kept: str) -> DataFrame:
    """``kept`` and the features, 0 where missing, as one vector ``features``.

    Trees pass over their rows several times before the first round. Stored as vectors the many columns are read
    and put together once, not in each pass.
    """
    values = F.array(*[F.col(c).cast("double") for c in features])
    return _numbers(rows, features).select(*kept, array_to_vector(values).alias("features"))


def fit_classifier(train: DataFrame, features: Sequence[str], label: str = "reordered", **settings) -> PipelineModel:
    """Fit :func:`classifier` on candidates of whole orders, a quarter of which decide when to stop."""
    assembler, trees = classifier(features, label, **settings).getStages()
    ready = vectors(train.withColumn(label, F.col(label).cast("double")), features, "order_id", label)
    return PipelineModel([assembler, trees.fit(materialize(with_validation(ready, "order_id"), "vectors", FOLD_ROWS))])


def rounds_used(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def classify(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with the probability of label 1 as ``score``."""
    out = model.transform(_numbers(rows, features))
    return out.withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def fit_report(model: PipelineModel, train: DataFrame, features: Sequence[str], label: str = "reordered") -> DataFrame:
    """Rows, positives, log loss, log loss of the plain share of positives, and rounds, for both training parts."""
    scored = classify(model, with_validation(train, "order_id"), features)
    share = F.avg(F.col(label).cast("double"))
    parts = scored.groupBy(F.when(F.col("held"), "validation").otherwise("grown").alias("part")).agg(
        F.count("*").alias("candidates"),
        F.sum(F.col(label).cast("bigint")).alias("positives"),
        F.avg(log_loss_term(F.col(label), F.col("score"))).alias("log_loss"),
        (-(share * F.ln(share) + (1 - share) * F.ln(1 - share))).alias("share_loss"),
    )
    return parts.withColumn("rounds", F.lit(rounds_used(model)))


def feature_importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Importance per feature name, largest first; one row per feature of the model."""
    importances = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(features, importances)]
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(F.desc("importance"), "feature")


# Basket sizes.

SIZE_FEATURES = [
    "bask_size_lag", "bask_size_lag1", "bask_size_lag2", "avg_b", "max_b", "min_b", "mode_b", "num_orders",
    "reorder_rate", "order_dow", "order_hour_of_day", "days_since_prior_order", "rate", "lengt", "avg_bask_lag",
]


def size_regression(
    rounds: int = 200,
    depth: int = 8,
    rate: float = 0.1,
    subsample: float = 0.8,
    columns: float = 0.8,
    least_rows: int = 2,
) -> Pipeline:
    """Boosted regression on the log basket size over the size features and the segment, a category."""
    segment = StringIndexer(
        inputCol="Segment", outputCol="segment_index", handleInvalid="keep", stringOrderType="alphabetAsc"
    )
    assembler = VectorAssembler(inputCols=[*SIZE_FEATURES, "segment_index"], outputCol="features")
    trees = GBTRegressor(
        labelCol="log_dep",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=subsample,
        featureSubsetStrategy=str(columns),
        minInstancesPerNode=least_rows,
        validationIndicatorCol="held",
        validationTol=TOLERANCE,
        seed=SEED,
    )
    return Pipeline(stages=[segment, assembler, trees])


def size_training(mart: DataFrame) -> DataFrame:
    """Rows of known basket size with its logarithm, marked for validation by user."""
    known = mart.filter("part = 'train' AND dep IS NOT NULL").fillna(0, subset=SIZE_FEATURES)
    return with_validation(known.withColumn("log_dep", F.ln(F.col("dep").cast("double"))), "user_id")


def fit_sizes(mart: DataFrame, **settings) -> PipelineModel:
    return size_regression(**settings).fit(size_training(mart))


def predict_sizes(model: PipelineModel, mart: DataFrame) -> DataFrame:
    """Predicted size of the next basket of each user to be scored, with the user's segment."""
    rows = mart.filter("part = 'score'").fillna(0, subset=SIZE_FEATURES)
    return model.transform(rows).select("user_id", "Segment", F.exp("prediction").alias("predicted"))


def size_errors(model: PipelineModel, mart: DataFrame) -> DataFrame:
    """Actual and fitted size of each training user, and the size guessed as the mean of the last baskets."""
    fitted = model.transform(size_training(mart))
    return fitted.select("user_id", F.col("dep").alias("actual"), F.exp("prediction").alias("predicted"), "avg_bask_lag")


# Cross-validation.


def with_folds(rows: DataFrame, orders: DataFrame, folds: int) -> DataFrame:
    """Rows (order_id, ...) with the contiguous fold of their order among ``orders``."""
    placed = order_folds(orders, folds).withColumn("fold", F.col("fold").cast("int"))
    return rows.join(placed, "order_id")


def cross_validate(
    estimator: Pipeline, rows: DataFrame, folds: int, evaluator: RegressionEvaluator | BinaryClassificationEvaluator
) -> DataFrame:
    """(fold, examples, rounds, score): each fold scored by the model of the others.

    ``rows`` brings ``fold``, 0 to ``folds`` - 1. They are worked out once and stored, since each fold reads them
    several times. As many models are fitted side by side as there are slots for.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "folds", FOLD_ROWS)
    sizes = dict(rows.groupBy("fold").count().collect())
    for fold in range(folds):
        # A fold without rows has no score, and one with all rows no model.
        if sizes.get(fold, 0) in (0, sum(sizes.values())):
            raise ValueError(f"fold {fold} has none or all of the rows")
    tasks = -(-sum(sizes.values()) // FOLD_ROWS)
    rows = rows.coalesce(tasks)

    def score(fold: int) -> tuple[int, int, int, float]:
        train = rows.filter(F.col("fold") != fold).persist()
        try:
            model = estimator.fit(train)
        finally:
            train.unpersist()
        part = rows.filter(F.col("fold") == fold)
        return fold, sizes[fold], rounds_used(model), float(evaluator.evaluate(model.transform(part)))

    # Rounds of a small model are many short jobs; those of a large one fill the cluster alone.
    abreast = min(folds, max(1, 2 * spark.sparkContext.defaultParallelism // tasks))
    with ThreadPool(abreast) as pool:
        scores = pool.map(inheritable_thread_target(spark)(score), range(folds), 1)
    return spark.createDataFrame(scores, "fold INT, examples BIGINT, rounds INT, score DOUBLE")


def cross_validate_classifier(mart: DataFrame, features: Sequence[str], folds: int = 5) -> DataFrame:
    """Area under the ROC curve per contiguous fold of orders, with five small rounds as a first look at a mart."""
    placed = with_folds(mart, mart.select("order_id"), folds).withColumn("reordered", F.col("reordered").cast("double"))
    _, trees = classifier(features, rounds=5, depth=6, subsample=0.75, columns=0.75, least_rows=1, validated=False).getStages()
    rows = vectors(placed, features, "fold", "reordered")
    return cross_validate(Pipeline(stages=[trees]), rows, folds, BinaryClassificationEvaluator(labelCol="reordered"))


def cross_validate_sizes(mart: DataFrame, target_orders: DataFrame, folds: int = 10, rounds: int = 500) -> DataFrame:
    """Root mean squared error of the log size per contiguous fold of the users' target orders."""
    keyed = size_training(mart).join(target_orders.select("user_id", "order_id"), "user_id")
    rows = with_folds(keyed, keyed.select("order_id"), folds)
    return cross_validate(size_regression(rounds), rows, folds, RegressionEvaluator(labelCol="log_dep", metricName="rmse"))


# Embeddings.


def held_basket(order_id: str = "order_id", percent: int = 10) -> Column:
    """Whether a basket is held out of training."""
    return id_bucket(F.col(order_id)) < percent


def skip_gram_pairs(lines: DataFrame, window: int = 1, percent: int = 10) -> DataFrame:
    """(part, product_id, context_id, pairs): how often a product has another near it in the cart.

    Near is at most ``window`` places away. ``percent`` of the baskets are the holdout. An order is read along its
    cart once; a task never joins an order with itself.
    """
    cart = Window.partitionBy("order_id").orderBy("add_to_cart_order")
    near = F.concat(
        F.collect_list("product_id").over(cart.rowsBetween(-window, -1)),
        F.collect_list("product_id").over(cart.rowsBetween(1, window)),
    )
    part = F.when(held_basket(), "holdout").otherwise("train").alias("part")
    pairs = lines.select(part, "product_id", near.alias("near")).select(
        "part", "product_id", F.explode("near").alias("context_id")
    )
    return pairs.groupBy("part", "product_id", "context_id").agg(F.count("*").alias("pairs"))


def sentences(lines: DataFrame) -> DataFrame:
    """Baskets as product ids in cart order (``products``, texts); at most a catalogue each."""
    items = F.array_sort(F.collect_list(F.struct("add_to_cart_order", "product_id")))
    return lines.groupBy("order_id").agg(items.alias("items")).select(
        "order_id", F.col("items.product_id").cast("array<string>").alias("products")
    )


def product_embeddings(
    baskets: DataFrame,
    size: int = 100,
    window: int | None = None,
    min_count: int = 2,
    rounds: int = 5,
    partitions: int = 8,
) -> DataFrame:
    """Skip-gram vectors of products, with baskets (``products``: ordered id texts) as sentences.

    No basket is cut; without ``window`` the longest one is the window. The trainer keeps two numbers per vector
    element on the driver, which is checked before it starts. ``partitions`` train side by side and are averaged after
    each round: more of them are faster and learn less per round.
    """
    facts = baskets.select(F.explode("products").alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    words = facts.filter(F.col("n") >= min_count).count()
    if 2 * 4 * size * words > MOST_VECTOR_BYTES:
        raise ValueError(
            f"{words} products of {size} numbers take more than {MOST_VECTOR_BYTES} bytes on the driver; "
            "raise min_count or embed aisles"
        )
    longest = max(baskets.agg(F.max(F.size("products"))).first()[0] or 1, 1)
    window = longest if window is None else window
    model = Word2Vec(
        numPartitions=partitions,
        inputCol="products",
        outputCol="unused",
        vectorSize=size,
        windowSize=window,
        maxSentenceLength=longest,
        minCount=min_count,
        maxIter=rounds,
        seed=SEED,
    ).fit(baskets)
    return model.getVectors().select(
        F.col("word").cast("bigint").alias("product_id"), vector_to_array("vector").alias("embedding")
    )


def holdout_similarity(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pairs, mean_cosine) over the holdout pairs whose products both have a vector."""

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, v: total + v)

    left = vectors.select("product_id", F.col("embedding").alias("a"))
    right = vectors.select(F.col("product_id").alias("context_id"), F.col("embedding").alias("b"))
    known = pairs.filter("part = 'holdout'").join(left, "product_id").join(right, "context_id")
    cosine = F.try_divide(dot("a", "b"), F.sqrt(dot("a", "a") * dot("b", "b")))
    return known.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), (F.sum(cosine * F.col("pairs")) / F.sum("pairs")).alias("mean_cosine")
    )


def project(embeddings: DataFrame, id_column: str, k: int = 2) -> DataFrame:
    """Principal components of an array column ``embedding``."""
    rows = embeddings.select(id_column, array_to_vector("embedding").alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="components").fit(rows)
    parts = vector_to_array("components")
    return model.transform(rows).select(id_column, *[parts[i].alias(f"component_{i + 1}") for i in range(k)])
