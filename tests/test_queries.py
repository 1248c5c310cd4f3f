"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from cartwise.queries import ENTRIES

SF = os.environ.get("CARTWISE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer supplier part orders lineitem events documents embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql is not None])
def test_query_equals_sql(spark, db, name):
    got = ENTRIES[name].build(spark, SF).toPandas()
    want = db.execute(ENTRIES[name].sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got) == len(want)
    a = got[columns].sort_values(columns, ignore_index=True)
    b = want[columns].sort_values(columns, ignore_index=True)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql is None])
def test_model_queries_run(spark, name):
    out = ENTRIES[name].build(spark, SF).toPandas()
    assert len(out) > 0
    if "score" in out:
        assert out.score.between(0, 1).all()
    if "importance" in out:
        assert out.importance.sum() == pytest.approx(1.0, abs=1e-4)
    if "predicted" in out:
        assert (out.predicted > 0).all()


PYTHON_ON_EXECUTORS = {"f1_optimal_k", "f1_optimal_k_no_none", "f1_baskets"}


@pytest.mark.parametrize(
    "name",
    ["training_mart", "recency_mart", "rolling_features", "basket_size_mart", "seq_padded", "scan_log_hive_nulls",
     "submission_with_none", "f1_baskets", "user_segments", "encode_names"],
)
def test_plans_have_no_cross_join_and_python_only_for_baskets(spark, name):
    plan = ENTRIES[name].plan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("ArrowEvalPython" in plan) == (name in PYTHON_ON_EXECUTORS)
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", ["training_mart", "recency_mart"])
def test_totals_need_no_window_over_a_user(spark, name):
    plan = ENTRIES[name].plan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_scan_prunes_columns(spark):
    plan = ENTRIES["product_stat"].plan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("order_hour_of_day" not in s and "dollars" not in s for s in schemas)


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
