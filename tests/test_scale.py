"""Work that must grow with the tables, on rows made here."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from cartwise.plans import marts, models, rolling
from cartwise.queries import ENTRIES
from cartwise.sources import baskets
from tests.conftest import rows

USERS, ORDERS, LINES = 12, 6, 5


@pytest.fixture(scope="module")
def star(spark):
    day = datetime.date(2020, 1, 1)
    keys = [(u * 100 + k, u) for u in range(USERS) for k in range(ORDERS)]
    orders = spark.createDataFrame(
        [(o, u, day + datetime.timedelta(days=(o * 7) % 90)) for o, u in keys], "order_id LONG, user_id LONG, order_date DATE"
    )
    part = spark.createDataFrame(
        [(p, f"brand {p % 3}", f"type {p % 4}", f"name {p}") for p in range(24)],
        "p_partkey LONG, p_brand STRING, p_type STRING, p_name STRING",
    )
    # A repeated product within an order, an unknown part, and a line of no order.
    lines = [(o, (o * 5 + k * k) % 25, k, 1.0 + k, 2.0 * k) for o, _ in keys for k in range(LINES)]
    lines += [(0, 3, 7, 1.0, 1.0), (0, 3, 8, 1.0, 1.0), (-1, 3, 1, 1.0, 1.0)]
    lineitem = spark.createDataFrame(
        lines, "l_orderkey LONG, l_partkey LONG, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE"
    )
    return orders, lineitem, part


def _buckets(spark, table):
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    name = plan.split("cartwise_")[1][:32]
    found = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED cartwise_{name}").collect()}
    return int(found["Num Buckets"])


def test_buckets_of_lines_grow_with_the_lines(spark, star, monkeypatch):
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = baskets.StoredBaskets(*star)
    assert _buckets(spark, few.lines) == session
    monkeypatch.setattr(baskets, "TASK_LINES", 10)
    many = baskets.StoredBaskets(*star)
    assert _buckets(spark, many.lines) == -(-star[1].count() // 10) > session
    assert rows(many.lines) == rows(few.lines)
    pairs = many.lines.groupBy("user_id", "product_id").agg(F.count("*").alias("n"))
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()


class _Stub:
    """Stands for an estimator and its model: fits only while another fold is being fitted too."""

    def __init__(self):
        self.together = threading.Barrier(2)
        self.trained = []

    def fit(self, train):
        self.trained.append(sorted(r.x for r in train.select("x").collect()))
        self.together.wait(60)
        return self

    @property
    def stages(self):
        return [type("Trees", (), {"getNumTrees": 3})()]

    def transform(self, rows):
        return rows

    def evaluate(self, rows):
        return float(rows.agg(F.sum("x")).first()[0])


def test_folds_of_small_rows_are_fitted_side_by_side(spark):
    rows_ = spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") % 4).cast("int").alias("fold"))
    stub = _Stub()
    scores = models.cross_validate(stub, rows_, 4, stub).orderBy("fold").collect()
    want = {k: [float(i) for i in range(20) if i % 4 == k] for k in range(4)}
    assert [tuple(r) for r in scores] == [(k, 5, 3, sum(v)) for k, v in want.items()]
    assert sorted(stub.trained) == sorted(sorted(x for j, v in want.items() if j != k for x in v) for k in want)
    with pytest.raises(ValueError, match="fold 4"):
        models.cross_validate(stub, rows_, 5, stub)


def test_trees_read_stored_vectors_in_even_files(spark, monkeypatch):
    given = spark.createDataFrame(
        [(k // 3, k % 2, float("nan") if k == 4 else k / 2, None if k == 5 else k) for k in range(90)],
        "order_id LONG, reordered INT, x DOUBLE, y INT",
    ).coalesce(1)
    found = models.vectors(given, ["x", "y"], "order_id").collect()
    want = [(k // 3, [0.0 if k == 4 else k / 2, 0.0 if k == 5 else float(k)]) for k in range(90)]
    assert [(r.order_id, r.features.toArray().tolist()) for r in found] == want
    monkeypatch.setattr(models, "FOLD_ROWS", 20)
    kept, seen = models.materialize, []

    def stored(*args):
        seen.append(kept(*args))
        return seen[-1]

    monkeypatch.setattr(models, "materialize", stored)
    model = models.fit_classifier(given, ["x", "y"], rounds=1, depth=1)
    scores = models.cross_validate_classifier(given, ["x", "y"], 3).orderBy("fold").collect()
    assert [(r.fold, r.examples) for r in scores] == [(0, 30), (1, 30), (2, 30)]
    assert models.classify(model, given, ["x", "y"]).filter("score BETWEEN 0 AND 1").count() == 90
    for table in seen:
        assert "features" in table.columns and not {"x", "y"} & set(table.columns)
        sizes = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == 90 and len(sizes) >= 5 and max(sizes) <= 20
    assert len(seen) == 2


def test_snapshots_have_a_row_per_window(spark, star, tmp_path):
    orders, lineitem, part = star
    named = {"order_id": "o_orderkey", "user_id": "o_custkey", "order_date": "o_orderdate"}
    for name, df in (("orders", orders.withColumnsRenamed(named)), ("lineitem", lineitem), ("part", part)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = ENTRIES["rolling_snapshots"].build(spark, str(tmp_path))
    lines = baskets.load(spark, str(tmp_path)).lines.select("order_id", "user_id", "product_id", "order_date").collect()
    first = min(r.order_date for r in lines)
    # Starts reach from 0 to the last counter, 0 in a short log, for train and 15 days on for test.
    want = [
        (0, r.order_id, r.product_id, split, r.user_id)
        for r in lines
        for split, start in (("train", 0), ("test", 15))
        if start <= (r.order_date - first).days <= start + 120
    ]
    assert rows(got) == sorted(want, key=repr)


def test_pairs_meet_all_totals_of_their_user_at_once(spark):
    pairs = spark.createDataFrame(
        [(1, 1, 7, 3, 2, 1), (1, 2, 7, None, 1, 0), (1, 3, None, None, 4, 3), (2, 1, 7, 3, 5, 4), (None, 1, 7, 3, 1, 0)],
        "user_id LONG, product_id LONG, department_id LONG, aisle_id LONG, up_orders LONG, reordered_sum LONG",
    )
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false")):
            spark.conf.set(k, v)
        out = marts.with_user_totals(pairs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        found = out.select(
            "user_id", "product_id", "user_total_products", "user_distinct_products", "dep_products", "dep_reordered",
            "aisle_products", "aisle_reordered",
        )
        got = {tuple(r) for r in found.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("department_id" in line or "aisle_id" in line for line in dealt)
    assert got == {
        (1, 1, 7, 3, 2, 1, 1, 1), (1, 2, 7, 3, 2, 1, 2, 3), (1, 3, 7, 3, 1, 3, 2, 3), (2, 1, 5, 1, 1, 4, 1, 4),
    }


def _dealt_by(spark, make):
    """What rows are shuffled by, without broadcasts."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false")):
            spark.conf.set(k, v)
        plan = make()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    return [line.split("hashpartitioning")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_daily_ranges_are_dealt_once_for_both_splits(spark, star):
    b = baskets.StoredBaskets(*star)
    dealt = _dealt_by(spark, lambda: rolling.ranges(b, rolling.Windows(span_days=20, shift_days=4)))
    assert dealt and not any("split" in keys for keys in dealt)


def test_touching_equal_ranges_become_one(spark):
    found = spark.createDataFrame(
        [(1, 0, 2, 5), (1, 3, 3, 5), (1, 4, 9, 5), (1, 10, 11, None), (1, 12, 12, None), (1, 14, 15, None), (2, 0, 1, 7), (2, 2, 3, 8)],
        "k INT, low INT, high INT, v INT",
    )
    got = rolling._neighbours_joined(found, ("k",), "low", "high")
    assert rows(got.select(F.struct("k", "low", "high", "v").alias("r")).select("r.*")) == rows(
        spark.createDataFrame(
            [(1, 0, 9, 5), (1, 10, 12, None), (1, 14, 15, None), (2, 0, 1, 7), (2, 2, 3, 8)], "k INT, low INT, high INT, v INT"
        )
    )


def test_rows_per_window_are_not_dealt(spark, star):
    b = baskets.StoredBaskets(*star)
    dealt = _dealt_by(spark, lambda: rolling.features(b, rolling.Windows(span_days=20, shift_days=4)))
    # Pairs meet their products by block of starts; only the events of difference arrays are dealt by start.
    assert any("product_id" in keys and "block" in keys and "user_id" not in keys for keys in dealt)
    assert not any("product_id" in keys and "start" in keys and "block" not in keys and "user_id" not in keys for keys in dealt)
    assert not any("counter" in keys or "split" in keys for keys in dealt)
