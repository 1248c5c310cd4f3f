"""All plans on baskets from star tables, CSV tables and a purchase log."""

import pytest
from pyspark.sql import functions as F

from cartwise.plans import candidates, decisions, gaps, histories, marts, recency, rolling, splits, stats
from cartwise.queries import base
from cartwise.sources import files
from cartwise.sources.baskets import LINE_COLUMNS, ORDER_COLUMNS, Baskets, conform, from_log, load, open_saved, save

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    star = load(spark, SF)
    log = splits.purchase_log(star, marts.customer_ranks(star.orders))
    numbers = star.orders.select("order_id", "order_number")
    log = log.join(numbers, "order_id").withColumn("order_id", F.col("order_number")).drop("order_number")
    path = str(tmp_path_factory.mktemp("log") / "log")
    files.write_csv(log.select(*[c.split()[0] for c in files.PURCHASE_LOG.split(", ")]), path, header=False, null="\\N")
    return {"star": star, "csv": base._basket_csv(spark, SF), "log": from_log(files.read_log(spark, path))}


PLANS = {
    "training mart": marts.training_mart,
    "lgbm": marts.lgbm_features,
    "compact mart": marts.compact_mart,
    "recency mart": recency.recency_mart,
    "snapshot mart": marts.snapshot_mart,
    "order profile": marts.order_profile,
    "labels": candidates.candidate_labels,
    "baskets": lambda b: decisions.baskets(decisions.scored(b)),
    "gaps": lambda b: gaps.purchase_gap_stats(gaps.numbered_gaps(b.prior)),
    "pairs": lambda b: stats.user_product_stat(b.prior),
    "histories": histories.history_product,
    "none": histories.history_none,
    "departments": histories.history_department,
    "unified": splits.unified_transactions,
}


@pytest.mark.parametrize("name", PLANS)
def test_plan_runs_on_every_source(loaded, name):
    counts = {source: PLANS[name](b).count() for source, b in loaded.items()}
    assert counts["star"] > 0 and counts["csv"] > 0 and counts["log"] > 0


def test_marts_of_a_log_equal_those_of_its_star(loaded):
    """For users all of whose orders have lines: a log has no empty orders."""
    star = loaded["star"]
    empty = star.orders.join(star.lines.select("order_id"), "order_id", "left_anti").select("user_id")
    same = ["user_id", "product_id", "up_orders", "last", "prev1", "median", "user_orders", "reordered"]

    def picked(source):
        rows = marts.training_mart(loaded[source]).join(empty, "user_id", "left_anti").select(*same)
        return sorted(tuple(float(v) for v in r) for r in rows.collect())

    assert len(picked("star")) > 1000 and picked("star") == picked("log")


@pytest.mark.parametrize("name", ["training mart", "compact mart", "recency mart", "snapshot mart", "labels"])
def test_unknown_labels_are_null(loaded, name):
    b = loaded["csv"]
    scored = b.orders.filter("eval_set = 'test'").select("user_id")
    rows = PLANS[name](b)
    assert rows.join(scored, "user_id").filter("reordered IS NOT NULL").count() == 0
    known = rows.join(scored, "user_id", "left_anti")
    assert known.count() > 0 and known.filter("reordered IS NULL").count() == 0


def test_rolling_windows_need_dates(loaded):
    w = rolling.Windows(count=2)
    assert rolling.ranges(loaded["csv"], w).count() == 0 and rolling.labels(loaded["csv"], w).count() == 0
    assert rolling.features(loaded["log"], w).count() > 0


def test_contract_is_checked(spark, loaded):
    b = loaded["star"]
    with pytest.raises(ValueError, match="lack gap"):
        Baskets(b.products, b.orders, b.lines.drop("gap"), 1)
    with pytest.raises(TypeError, match="user_id"):
        Baskets(b.products, b.orders.withColumn("user_id", F.lit("x")), b.lines, 1)
    with pytest.raises(ValueError, match="reordered"):
        conform(b.lines.drop("reordered"), LINE_COLUMNS)
    assert conform(b.orders.drop("order_date"), ORDER_COLUMNS).filter("order_date IS NOT NULL").count() == 0


def test_integer_keys_never_collide(spark):
    rows = spark.createDataFrame(
        [(1, 1, 100_000), (2, 1, 0), (1, 2, 7)], "user_id BIGINT, order_number BIGINT, product_id BIGINT"
    )
    assert splits.composite_keys(rows).select("user_product").distinct().count() == 3
    assert {r.user_product for r in splits.composite_keys(rows.filter("product_id < 9")).collect()} == {200_000, 100_007}


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_pairs_of_stored_lines_need_no_shuffle(loaded):
    for b in loaded.values():
        assert exchanges(stats.pairs(b.lines)) == exchanges(stats.pairs(b.prior)) == 0
        assert exchanges(candidates.bought_before_and_now(b.lines)) == 0


def test_saved_baskets_serve_another_session(spark, loaded, tmp_path):
    folder = str(tmp_path / "kept")
    save(loaded["csv"], folder)
    other = open_saved(spark.newSession(), folder)
    assert exchanges(stats.pairs(other.lines)) == 0 and not other.test_lines
    want = sorted(map(tuple, stats.pairs(loaded["csv"].lines).collect()))
    assert sorted(map(tuple, stats.pairs(other.lines).collect())) == want
    assert marts.compact_mart(other).count() == marts.compact_mart(loaded["csv"]).count()


def test_the_next_purchase_of_a_log_is_found_without_joining_lines_with_lines(loaded):
    star = loaded["star"]
    ranks = marts.customer_ranks(star.orders)
    log = splits.purchase_log(star, ranks)
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "pair_nth" in x]
    # Long histories are cut; the rows are the same.
    cut = splits.purchase_log(Baskets(star.products, star.orders, star.lines, 10**9), ranks)
    assert sorted(map(repr, log.collect())) == sorted(map(repr, cut.collect()))
    following = {(r.user_id, r.product_id, r.visit_date): r.cust_prod_lead_date for r in log.collect()}
    assert any(following.values()) and all(d is None or d >= k[2] for k, d in following.items())
