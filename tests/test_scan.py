"""Ordered scans, global ranks and lookup joins: every strategy gives the same rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cartwise.operators import joins, scan
from tests.conftest import rows


@pytest.fixture(scope="module")
def purchases(spark):
    rng = random.Random(5)
    data = []
    for user in range(12):
        # User 0 has a third of all rows.
        n = 60 if user == 0 else rng.randint(1, 18)
        data += [(user, i + 1, rng.choice([None, 1, 2, 7])) for i in range(n)]
    return spark.createDataFrame(data, "user_id BIGINT, pos BIGINT, v BIGINT").repartition(5)


def test_ordered_scan_split_equals_plain_and_python(purchases):
    def run(split):
        return scan.ordered_scan(
            purchases,
            ["user_id"],
            ["pos"],
            [scan.position_block("pos", 4)],
            running={"nth": F.lit(1), "upto": F.col("v")},
            previous={"before": F.col("v")},
            whole={"n": ("sum", F.lit(1)), "low": ("min", F.col("v")), "high": ("max", F.col("v"))},
            split=split,
        )

    assert rows(run(True)) == rows(run(False))
    groups = defaultdict(list)
    for r in purchases.orderBy("user_id", "pos").collect():
        groups[r.user_id].append(r.v)
    for r in run(True).collect():
        values = groups[r.user_id]
        known = [v for v in values if v is not None]
        seen = [v for v in values[: r.pos] if v is not None]
        assert r.nth == r.pos and r.n == len(values)
        assert r.upto == (sum(seen) if seen else None)
        assert r.before == (values[r.pos - 2] if r.pos > 1 else None)
        assert (r.low, r.high) == ((min(known), max(known)) if known else (None, None))


def test_split_scan_never_partitions_rows_by_user_alone(purchases):
    split = scan.ordered_scan(
        purchases, ["user_id"], ["pos"], [scan.position_block("pos", 4)], previous={"before": F.col("v")}, split=True
    )
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    row_windows = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert row_windows and all("__cut0" in line for line in row_windows)


def test_global_rank(spark):
    values = random.Random(1).sample(range(10_000), 700)
    df = spark.createDataFrame([(v, v % 3) for v in values], "x BIGINT, g BIGINT").repartition(6)
    got = scan.global_rank(df, [F.desc("g"), F.asc("x")], "rank", "total").collect()
    want = {x: i + 1 for i, x in enumerate(sorted(values, key=lambda v: (-(v % 3), v)))}
    assert {r.x: r["rank"] for r in got} == want
    assert {r.total for r in got} == {700}


@pytest.mark.parametrize("n", [1, 3, 10, 23, 105])
def test_ntile_like_sql(spark, n):
    df = spark.range(1, n + 1).withColumn("tile", scan.ntile(F.col("id"), F.lit(n), 10))
    df.createOrReplaceTempView("ranked")
    bad = spark.sql("SELECT * FROM (SELECT tile, ntile(10) OVER (ORDER BY id) AS want FROM ranked) WHERE tile <> want")
    assert bad.count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_a_hot_key(spark, how):
    left = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("row")
    )
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = rows(joins.lookup_join(left, dim, "k", how))
    keys = [7 if i % 3 == 0 else i % 50 for i in range(900)]
    want = [(k, i, k * 10 if k < 40 else None) for i, k in enumerate(keys) if how == "left" or k < 40]
    assert sorted(got) == sorted(want, key=lambda r: (r[0], r[1]))
