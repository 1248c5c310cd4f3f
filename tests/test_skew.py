"""One user with a third of all orders: cut and uncut ways give the same marts."""

import datetime as dt
import random

import pytest

from cartwise.operators import scan
from cartwise.plans import decisions, gaps, histories, marts, recency, rolling, splits, stats
from cartwise.sources.baskets import Baskets, number_orders, order_lines
from tests.conftest import rows


def frames(spark):
    rng = random.Random(3)
    start = dt.date(2020, 1, 1)
    orders, lines, oid = [], [], 0
    for user in range(16):
        for _ in range(75 if user == 0 else rng.randint(1, 18)):
            oid += 1
            orders.append((oid, user, start + dt.timedelta(rng.randint(0, 170))))
            for line in range(rng.randint(0, 5)):
                product = 1 if rng.random() < 0.33 else rng.randint(2, 9)
                lines.append((oid, product, line, 1.0, 2.5))
    raw = spark.createDataFrame(orders, "order_id BIGINT, user_id BIGINT, order_date DATE").repartition(4)
    keyed = spark.createDataFrame(lines, "order_id BIGINT, product_id BIGINT, line INT, units DOUBLE, dollars DOUBLE")
    products = spark.createDataFrame(
        [(i, f"name {i % 3}", i % 4 + 1, i % 2 + 1, f"a{i % 4}", f"d{i % 2}") for i in range(1, 10)],
        "product_id BIGINT, product_name STRING, aisle_id BIGINT, department_id BIGINT, aisle STRING, department STRING",
    )
    return products, raw, keyed.repartition(4)


def build(spark, split):
    products, raw, keyed = frames(spark)
    orders = number_orders(raw, split)
    lines = order_lines(keyed, orders, split).cache()
    return Baskets(products, orders.cache(), lines, scan.GROUP_ROWS + 1 if split else 75)


@pytest.fixture(scope="module")
def both(spark):
    return build(spark, False), build(spark, True)


PLANS = {
    "orders": lambda b: b.orders,
    "lines": lambda b: b.lines,
    "timeline": lambda b: gaps.order_timeline(b.orders, b.split),
    "gap stats": lambda b: gaps.purchase_gap_stats(gaps.numbered_gaps(b.prior)),
    "gap stats with target": lambda b: gaps.purchase_gap_stats(gaps.numbered_gaps(b.lines, True)),
    "scanned gap stats": lambda b: gaps.purchase_gap_stats(gaps.scanned_gaps(b.prior, b.split)),
    "user product stat": lambda b: stats.user_product_stat(b.prior),
    "order rank": lambda b: recency.with_order_rank(b.lines, b.split),
    "training mart": marts.training_mart,
    "recency mart": recency.recency_mart,
    "snapshot mart": marts.snapshot_mart,
    "basket sizes": lambda b: marts.basket_size_mart(marts.order_profile(b)),
    "rolling": lambda b: rolling.features(b, rolling.Windows(count=3, span_days=60, horizon_days=9)),
    "purchase log": lambda b: splits.purchase_log(b, marts.customer_ranks(b.orders)),
    "histories": lambda b: histories.history_product(b),
    "none histories": lambda b: histories.history_none(b),
    "department histories": lambda b: histories.history_department(b),
    "sequences": lambda b: histories.user_sequences(b),
    "baskets": lambda b: decisions.baskets(decisions.scored(b)),
}


@pytest.mark.parametrize("name", PLANS)
def test_cut_histories_give_the_same_rows(both, name):
    plain, cut = (rows(PLANS[name](b)) for b in both)
    assert len(plain) > 0
    assert [tuple(map(tidy, r)) for r in plain] == [tuple(map(tidy, r)) for r in cut]


def test_stored_and_scanned_gaps_agree(both):
    b = both[1]
    for lines, target in ((b.prior, False), (b.lines, True)):
        stored = gaps.purchase_gap_stats(gaps.numbered_gaps(lines, target))
        assert rows(stored) == rows(gaps.purchase_gap_stats(gaps.scanned_gaps(lines)))


def tidy(v):
    return round(v, 9) if isinstance(v, float) else v


ARRAYS = [f"{n}_history" for n in histories.HISTORIES]


@pytest.mark.parametrize("plan", [histories.history_product, histories.history_none])
def test_chunks_put_together_are_the_history(both, plan):
    b = both[1]
    whole = {(r.user_id, r.product_id): r for r in plan(b, 1000).collect()}
    joined = {}
    for r in sorted(plan(b, 7).collect(), key=lambda r: r.chunk):
        assert len(r.order_number_history) <= 7
        part = joined.setdefault((r.user_id, r.product_id), {a: [] for a in ARRAYS} | {"label": r.label})
        for a in ARRAYS:
            part[a] += r[a]
        assert part["label"] == r.label
    assert joined.keys() == whole.keys()
    for key, part in joined.items():
        assert {a: whole[key][a] for a in ARRAYS} | {"label": whole[key].label} == part


def test_keeping_the_first_chunk_only_cuts_orders(both):
    b = both[1]
    first = histories.history_product(b, 7, keep_chunks=1)
    assert rows(first) == rows(histories.history_product(b, 7).filter("chunk = 0"))


def test_histories_match_plain_python(both):
    b = both[0]
    baskets = {}
    for r in b.lines.orderBy("add_to_cart_order").collect():
        baskets.setdefault(r.user_id, {}).setdefault(r.order_number, []).append(r.product_id)
    want = {}
    for user, orders in baskets.items():
        numbers = sorted(orders)
        past, following = [orders[n] for n in numbers[:-1]], orders[numbers[-1]]
        seen, again = set(), []
        for basket in past:
            again.append(len(seen & set(basket)))
            seen |= set(basket)
        for product in seen:
            want[user, product] = (
                [int(product in o) for o in past],
                [o.index(product) + 1 if product in o else 0 for o in past],
                [len(o) for o in past],
                again,
                numbers,
                int(product in following),
            )
    got = {(r.user_id, r.product_id): (*(r[a] for a in ARRAYS), r.label) for r in histories.history_product(b).collect()}
    assert got == want


def test_rolling_windows_hold_each_line_as_often_as_it_fits(both):
    b, w = both[0], rolling.Windows(count=5, span_days=40, shift_days=6)
    first = min(r.order_date for r in b.lines.collect())
    want = 0
    for r in b.lines.collect():
        day = (r.order_date - first).days
        want += sum(i + s <= day <= i + s + 40 for i in range(5) for s in (0, 6))
    assert rolling.snapshots(b, w).count() == want


def test_catalogue_ids_are_dense_ranks(spark):
    from cartwise.sources import baskets

    part = spark.createDataFrame(
        [(f"B{i % 7}", f"T{i % 3}", f"n{i}") for i in range(40)], "p_brand STRING, p_type STRING, p_name STRING"
    )
    pairs = sorted({(f"B{i % 7}", f"T{i % 3}") for i in range(40)})
    brands, types = sorted({b for b, _ in pairs}), sorted({t for _, t in pairs})
    want = {(b, t): (k + 1, brands.index(b) + 1, types.index(t) + 1) for k, (b, t) in enumerate(pairs)}
    got = {(r.aisle, r.department): (r.product_id, r.aisle_id, r.department_id) for r in baskets.catalogue(part).collect()}
    assert got == want


def test_windows_reach_the_last_day(both):
    b = both[0]
    days = [r.order_date for r in b.lines.collect()]
    first, last = min(days), max(days)
    w = rolling.Windows(span_days=30, shift_days=6, stride_days=20)
    got = rolling.snapshots(b, w).groupBy("split", "counter").count().collect()
    count = w.over((last - first).days).count
    assert max(r.counter for r in got) == count - 1
    want = {}
    for d in days:
        for s, shift in (("train", 0), ("test", 6)):
            for i in range(count):
                if i * 20 + shift <= (d - first).days <= i * 20 + shift + 30:
                    want[s, i] = want.get((s, i), 0) + 1
    assert {(r.split, r.counter): r["count"] for r in got} == want
    assert (count - 1) * 20 + 6 + 30 + 1 >= (last - first).days


def test_submission_has_every_order(both):
    b = both[0]
    got = decisions.submission(decisions.predict(decisions.scored(b), 2.0), b.target_orders).collect()
    assert len(got) == b.target_orders.count() and {r.products for r in got} == {"None"}
