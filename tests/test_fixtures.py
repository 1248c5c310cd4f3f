"""Hand-worked examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartwise.functions import columns as c
from cartwise.plans import decisions, gaps, metrics, splits, stats, text
from cartwise.sources import files
from cartwise.sources.baskets import number_orders
from tests.conftest import rows


def test_timeline_counts_unknown_gaps_as_zero(spark):
    orders = spark.createDataFrame(
        [(1, 1, None), (1, 2, 7), (1, 3, 8), (1, 4, None), (1, 5, 2)],
        "user_id BIGINT, order_number BIGINT, days_since_prior_order BIGINT",
    )
    for split in (False, True):
        out = gaps.order_timeline(orders, split).orderBy("order_number").collect()
        assert [r.days_since_prior_order_comsum for r in out] == [0, 7, 15, 15, 17]


def test_gap_statistics(spark):
    data = [(1, p, i + 1, t, len(ts)) for p, ts in {1: [0, 7, 15, 17], 2: [0, 30], 3: [4]}.items() for i, t in enumerate(ts)]
    lines = spark.createDataFrame(
        data, "user_id BIGINT, product_id BIGINT, order_number BIGINT, timeline BIGINT, pair_lines BIGINT"
    )
    for split in (False, True):
        got = {r.product_id: r for r in gaps.purchase_gap_stats(gaps.scanned_gaps(lines, split)).collect()}
        one = got[1]
        assert (one["last"], one["prev1"], one["prev2"], one["median"], one["mean"], one["sdev"]) == (2, 8, 7, 7.5, 7.5, 0.5)
        two, three = got[2], got[3]
        assert (two["last"], two["prev1"], two["prev2"], two["median"], two["mean"], two["sdev"]) == (30, None, None, None, None, None)
        assert all(three[k] is None for k in gaps.GAP_COLUMNS)


def test_medians_of_many_lines_equal_a_full_sort(spark):
    import statistics

    values = [(1, 1, v, 7) for v in (3, 9, 9, 1, 4, 4, 20)] + [(1, 2, v, 2) for v in (5, 8)] + [(2, 1, None, 1)]
    lines = spark.createDataFrame(values, "user_id BIGINT, product_id BIGINT, x BIGINT, pair_lines BIGINT")
    keys = ["user_id", "product_id"]
    means = lines.groupBy(*keys).agg(F.avg("x").alias("m"))
    got = {tuple(r[k] for k in keys): r["md"] for r in stats.with_medians(means, lines, keys, {"x": ("m", "md")}).collect()}
    assert got == {(1, 1): statistics.median((3, 9, 9, 1, 4, 4, 20)), (1, 2): 6.5, (2, 1): None}


def test_reorder_probability(spark):
    lines = spark.createDataFrame(
        [(1, 1, 0, 1), (1, 1, 1, 1), (2, 1, 0, 1)],
        "user_id BIGINT, product_id BIGINT, reordered INT, add_to_cart_order INT",
    )
    row = stats.product_stat(stats.pairs(lines)).first()
    assert row.reorder_prob == 0.5 and row.prod_users_unq == 2 and row.prod_users_unq_reordered == 1


def test_number_orders_on_busy_days(spark):
    day = dt.date(2020, 1, 5)
    raw = spark.createDataFrame(
        [(1, 9, day), (2, 9, day), (5_000_000, 9, day), (3, 9, day + dt.timedelta(7)), (4, 10, day)],
        "order_id BIGINT, user_id BIGINT, order_date DATE",
    )
    plain, split = number_orders(raw, False), number_orders(raw, True)
    assert rows(plain) == rows(split)
    got = {r.order_id: r for r in split.collect()}
    assert [got[i].order_number for i in (1, 2, 5_000_000, 3)] == [1, 2, 3, 4]
    assert [got[i].days_since_prior_order for i in (1, 2, 5_000_000, 3)] == [None, 0, 0, 7]
    assert got[3].eval_set == "test" and got[4].eval_set == "train" and got[1].order_dow == 0


def test_arrays(spark):
    df = spark.sql("SELECT array(3, 1) AS a, array(1, 2, 3, 4, 5) AS b, CAST(array() AS array<int>) AS e")
    r = df.select(
        c.pad(F.col("a"), 4).alias("pa"),
        c.pad(F.col("b"), 4).alias("pb"),
        c.padded_length(F.col("a"), 4).alias("la"),
        c.padded_length(F.col("b"), 4).alias("lb"),
        c.shift_left(F.col("b")).alias("sb"),
        c.shift_left(F.col("e")).alias("se"),
        c.without_last(F.col("e")).alias("we"),
        c.without_last(F.col("a")).alias("wa"),
        c.one_hot(F.lit(2), 4).alias("hot"),
        c.one_hot(F.lit(9), 4).alias("out"),
    ).first()
    assert r.pa == [3, 1, 0, 0] and r.pb == [1, 2, 3, 4] and (r.la, r.lb) == (2, 4)
    assert r.sb == [2, 3, 4, 5, 1] and r.se == [] and r.we == [] and r.wa == [3]
    assert r.hot == [0, 0, 1, 0] and r.out == [0, 0, 0, 0]


def test_nested_codec_round_trip(spark):
    df = spark.sql("SELECT array(array(1L, 20L), array(3L)) AS n")
    r = df.select(c.encode_nested(F.col("n")).alias("t")).withColumn("back", c.decode_nested(F.col("t"))).first()
    assert r.t == "1_20 3" and r.back == [[1, 20], [3]]


def test_scalars(spark):
    r = spark.range(1).select(
        c.circular_hours(F.lit(23), F.lit(1)).alias("h"),
        c.circular_hours(F.lit(0), F.lit(12)).alias("g"),
        c.ratio(F.lit(1), F.lit(0)).alias("z"),
        c.mean_of_known(F.lit(2), F.lit(None).cast("int"), F.lit(5)).alias("m"),
        c.mean_of_known(F.lit(None).cast("int")).alias("none"),
    ).first()
    assert (r.h, r.g, r.z, r.m, r.none) == (2, 12, None, 3.5, None)


def test_submission_orders_products_numerically(spark):
    rows_ = spark.createDataFrame(
        [(1, 10, 1), (1, 2, 1), (2, 7, 0)], "order_id BIGINT, product_id BIGINT, predicted INT"
    )
    orders = spark.createDataFrame([(1,), (2,), (3,)], "order_id BIGINT")
    got = [tuple(r) for r in decisions.submission(rows_, orders).collect()]
    assert got == [(1, "2 10"), (2, "None"), (3, "None")]


def test_none_probability(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.2)], "order_id BIGINT, score DOUBLE")
    assert decisions.none_probability(df).first().p_none == pytest.approx(0.56)


def test_blend_matches_by_key_not_by_position(spark):
    one = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.4)], "order_id BIGINT, product_id BIGINT, score DOUBLE")
    two = spark.createDataFrame([(1, 2, 0.0), (1, 1, 1.0)], "order_id BIGINT, product_id BIGINT, score DOUBLE")
    got = {r.product_id: r.score for r in decisions.blend(one, two).collect()}
    assert got == {1: pytest.approx(0.6), 2: pytest.approx(0.2)}


def test_mean_f1_counts_orders_without_truth_or_guess_as_zero(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.9), (1, 0, 0.8), (2, 0, 0.1)], "order_id BIGINT, reordered INT, score DOUBLE"
    )
    got = metrics.mean_f1(df, (0.5,)).first()
    assert got.mean_f1 == pytest.approx((2 / 3 + 0.0) / 2)


def test_sequence_losses_stop_at_length(spark):
    df = spark.sql("SELECT array(1, 0, 1) AS y, array(0.5D, 0.5D, 0.0D) AS p, 2 AS n")
    loss = metrics.sequence_log_loss(df, "y", "p", "n").first()[0]
    rmse = metrics.sequence_rmse(df, "y", "p", "n").first()[0]
    assert loss == pytest.approx(0.6931471805599453) and rmse == pytest.approx(0.5)


def test_vocabulary_and_encoding(spark):
    names = [("Red Apple",)] * 11 + [("red  pear",), (" ",)]
    df = spark.createDataFrame(names, "product_name STRING").withColumn("id", F.monotonically_increasing_id())
    vocab = text.vocabulary(df, "id")
    assert {r.word: (r.word_count, r.word_id) for r in vocab.collect()} == {"red": (12, 1), "apple": (11, 2), "pear": (1, 0)}
    encoded = sorted(tuple(r.name_ids) for r in text.encode(df, "id", vocab).collect())
    assert encoded == [(0,)] + [(1, 0)] + [(1, 2)] * 11


def test_order_folds(spark):
    orders = spark.range(10, 33).withColumnRenamed("id", "order_id")
    dropped = {r.order_id: r.fold for r in splits.order_folds(orders, 5, keep_remainder=False).collect()}
    kept = {r.order_id: r.fold for r in splits.order_folds(orders, 5).collect()}
    assert dropped == {10 + i: i // 4 for i in range(20)}
    assert kept == {10 + i: min(i // 4, 4) for i in range(23)}


def test_log_null_markers(spark, tmp_path):
    line = "7,2020-01-02,5,1.0,2.5,\\N,\\N,9,0,{gap},\\N,4,Thursday,1,January,1,2020,1,3,1"
    (tmp_path / "log.csv").write_text("\n".join(line.format(gap=g) for g in ("\\N", "99999", "6")) + "\n")
    got = files.read_log(spark, str(tmp_path / "log.csv")).collect()
    assert sorted(str(r.days_since_prior_order) for r in got) == ["6.0", "None", "None"]
    assert all(r.visit_date == dt.date(2020, 1, 2) and r.cust_lead_date is None for r in got)
