"""Hard negatives, url filters and periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise.llm import hardneg, periodic, queries, urlfilter
from cartwise.llm.strassen import multiply
from tests.llm.conftest import AWKWARD


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 3, 7), (64, 64, 64), (65, 33, 127), (200, 64, 301), (40, 0, 40)])
@pytest.mark.parametrize("leaf", [1, 2, 32])
def test_strassen_equals_plain_product(shape, leaf):
    m, k, n = shape
    rng = np.random.default_rng(m * n)
    a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
    if m * k * n < 50_000:
        leaf = min(leaf, 2)
    assert (multiply(a, b, leaf) == a @ b).all()
    small = multiply(a.astype(object)[:9, :9], b.astype(object)[:9, :9], 2)
    assert (small == a.astype(object)[:9, :9] @ b.astype(object)[:9, :9]).all()


def test_products_beyond_64_bit_sums_are_exact_or_refused():
    big = float(2**40)
    assert hardneg.product(np.array([[big, big]]), np.array([[big, -big]])).tolist() == [[0]]
    with pytest.raises(OverflowError):
        hardneg.product(np.array([[big, big]]), np.array([[big, big]]))


VECTORS = "vec_id long, embedding array<float>, label int, score double, cid long, copies long, owner string, v int, dim int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, c, 0.5, 1, 1, "x", 1, 1) for i, v, c in rows], VECTORS)


def brute_negatives(rows, positives, negatives):
    """The contract, row by row."""
    fine = [
        (i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v), c)
        for i, v, c in rows
        if c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    last = (1 << 70,)

    def order(r):
        return -r[0], r[1] if r[1] is not None else last[0]

    out = []
    for n, (i, v, c) in enumerate(fine):
        if i is None or i % 100:
            continue
        scored = [
            (sum(x * y for x, y in zip(v, w, strict=True)), j, d)
            for m, (j, w, d) in enumerate(fine)
            if m != n and len(w) == len(v)
        ]
        for s, j, _ in sorted((r for r in scored if r[2] == c), key=order)[:positives]:
            window = [r for r in scored if r[2] != c and 30 * s <= 100 * r[0] <= 90 * s]
            out += [(i, rank, t, k, s, j) for rank, (t, k, _) in enumerate(sorted(window, key=order)[:negatives], 1)]
    return sorted(((a, r, k, s, t, j) for a, r, t, k, s, j in out), key=repr)


def mined(frame, **options):
    found = hardneg.mine(frame, F.col("vec_id") % 100 == 0, **options)
    return sorted(
        ((r.anchor_id, r["rank"], r.negative_id, r.positive_score, r.negative_score, r.positive_id) for r in found.collect()),
        key=repr,
    )


def some_vectors(seed, n, labels, hot=0):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        i = rng.choice([rng.randrange(0, 2000, 20), rng.randrange(2000)])
        made.append((i, [rng.choice([-0.5, 0.25, 0.5, 0.501, 1.0]) for _ in range(6)], rng.randrange(labels)))
    made += [made[3]] * hot
    made += [(100, made[5][1], 1), (None, made[6][1], 0), (None, made[6][1], 1), (200, None, 1), (300, [1.0, None] * 3, 0)]
    made += [(400, [1.0, float("nan")] * 3, 0), (500, [float("inf")] * 6, 1), (600, made[7][1], None), (700, [], 0), (701, [], 1)]
    made += [(702, [], 0), (800, [0.5] * 3, 0), (801, [1.0] * 3, 0), (802, [0.4] * 3, 1), (0, [0.0] * 6, 0)]
    return made


@pytest.mark.parametrize(("seed", "labels", "hot"), [(1, 2, 0), (2, 5, 7), (3, 40, 0)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, labels, hot):
    rows = some_vectors(seed, 220, labels, hot)
    # Cells and tiles of a few rows, so that heaps are merged.
    monkeypatch.setattr(hardneg, "GROUP_LEAST", 40)
    monkeypatch.setattr(hardneg, "GROUPS", 4)
    monkeypatch.setattr(hardneg, "ANCHOR_BYTES", 500)
    # Cells of one place must meet although their rows are dealt over several tasks.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert mined(vectors(spark, rows)) == brute_negatives(rows, 5, 10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hard_negatives_of_one_hot_row(spark):
    rows = [(100, [1.0, 0.5], 0)] * 60 + [(7, [1.0, 0.25], 0)] * 60 + [(k, [0.5, k / 100], 1) for k in range(30)]
    assert mined(vectors(spark, rows)) == brute_negatives(rows, 5, 10)
    assert mined(vectors(spark, rows), positives=70, negatives=3) == brute_negatives(rows, 70, 3)


def test_hard_negatives_of_nothing(spark):
    assert hardneg.mine(vectors(spark, []), F.col("vec_id") == 0).collect() == []
    assert mined(vectors(spark, [(100, [1.0], 1)])) == []


def test_heaps_merge():
    keys = (np.zeros(9, bool), np.array([5, 4, 3, 2, 1, 0, 9, 8, 7]), np.arange(9))
    scores = np.array([1, 9, 9, 3, 3, -(2**63), 9, 2**62, 0])
    one, two, all_at_once = hardneg.Heap(4), hardneg.Heap(4), hardneg.Heap(4)
    one.offer(scores[:4], np.arange(4), keys)
    two.offer(scores[4:], np.arange(4, 9), keys)
    one.merge(two, keys)
    all_at_once.offer(scores, np.arange(9), keys)
    assert one.at.tolist() == all_at_once.at.tolist() == [7, 2, 1, 6]


# Urls.


def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fit = [
        (len(r.host + r.path), len(r.host), r.host + r.path, r.verdict)
        for r in rules
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return (host, path, *max(fit)[2:]) if fit else (host, path, None, default)


URLS = [
    None, "", "example.org/es/", "http://", "http:///es/", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org/en/1",
    "http://example.org/en/12/", "http://example.org/en/2", "http://notexample.org/es/", "http://a.b.com/fr/", "http://com/de/",
    "http://x.com?/de/", "http://x.com#/de/", "http://x.com/de", "http://ÄB.com/de/", "a://b://c.org/x", "http://c.org",
    "http://x.net/es/\nhttp://example.org/es/", "http://.org/", "http://org./", "http://" + "a." * 5000 + "org/" + "x/" * 50000,
    "http://example.com:80/de/", "http://x.com/DE/",
]


def test_verdicts_of_the_query(spark):
    rules = queries.url_rules()
    frame = spark.createDataFrame(
        [(k % 20 or None, u, "x", "y", "z", "w") for k, u in enumerate(URLS)],
        "page_id long, url string, host string, path string, rule string, key string",
    )
    got = urlfilter.judge(frame, rules)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(k % 20 or None, *brute_verdict(u, rules)) for k, u in enumerate(URLS)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_many_rules_need_several_levels_and_stay_exact(spark):
    rng = random.Random(4)
    hosts = [f"h{k}.{d}" for k in range(60) for d in ("com", "org", "co.uk")] + ["com", "uk", "org"]
    rules = {}
    for _ in range(900):
        r = urlfilter.Rule(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["", "/", "/a", "/ab/", "/b/cc"]))
        rules.setdefault(r.key, r)
    rules = list(rules.values())
    urls = [
        f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a', '/abc', '/ab/c', '/b/ccc'])}"
        for _ in range(4000)
    ]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlfilter.judge(frame, rules, default="block").collect()
    assert sorted(map(tuple, got)) == sorted((k, *brute_verdict(u, rules, "block")) for k, u in enumerate(urls))


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(0, 3000, 7).selectExpr("concat('k', id) AS key")
    universe = spark.range(3000).selectExpr("concat('k', id) AS key")
    cascade = urlfilter.build_cascade(listed, universe, rate=0.4)
    assert len(cascade.levels) >= 3
    wrong = universe.filter(cascade.contains(F.col("key")) != (F.substring("key", 2, 9).cast("int") % 7 == 0))
    assert wrong.count() == 0
    assert not universe.filter(urlfilter.build_cascade(listed.limit(0), universe).contains(F.col("key"))).count()


def test_judging_stays_on_the_jvm_and_joins_nothing(spark, small):
    plan = queries.op12_url_filters(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Join", "Exchange"))


def test_rules_that_contradict_or_are_no_rules(spark):
    frame = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(frame, queries.url_rules()).count() == 0
    assert urlfilter.judge(frame, []).count() == 0
    with pytest.raises(ValueError, match="both"):
        urlfilter.judge(frame, [urlfilter.Rule("allow", "a.org"), urlfilter.Rule("block", "A.org")])
    for bad in (("maybe", "a"), ("allow", ""), ("allow", "a/b"), ("allow", "a", "b"), ("allow", "a", "/b?c")):
        with pytest.raises(ValueError):
            urlfilter.Rule(*bad)


# Periodic runs.


def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def word_lists():
    rng = random.Random(5)
    for k in range(300):
        n, kinds = rng.choice([5, 12, 40, 90, 200, 500]), rng.choice([1, 2, 4, 30, 300])
        w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
        if k % 3 == 0:
            a, p = rng.randrange(n), 1 + n // rng.randrange(2, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if k % 4 == 0:
            w[rng.randrange(n)] = "once"
        yield w


def test_runs_equal_brute_force():
    for w in word_lists():
        assert periodic.runs_of([x.encode() for x in w]) == brute_runs(w)
        assert periodic.runs_of([x.encode() for x in w], 4) == brute_runs(w, 4)


def test_splitting_repeats_until_stable():
    # y occurs twice, but once in each part that the words occurring once leave.
    ids = periodic.numbered(("a b " * 10 + "y " + "c d " * 10 + "once " + "e f " * 10 + "y " + "g h " * 10).encode().split())
    assert periodic.segments(ids) == [(0, 20), (21, 41), (42, 62), (63, 83)]


def test_long_texts_with_long_periods():
    part = [b"%d" % (k * k % 7919) for k in range(9000)]
    assert periodic.runs_of(part[:7000] * 3) == [(0, 21_000, 7000)]
    assert periodic.runs_of([b"a"] * 30_000) == [(0, 30_000, 1)]


def test_runs_of_awkward_texts(spark, awkward, nothing):
    assert periodic.find(nothing).count() == 0
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find(awkward).collect()), key=repr)
    want = []
    for i, t in AWKWARD:
        w = (t or "").encode().split()
        # The long sentence goes through 18 words and 97 numbers.
        found = brute_runs(w) if len(w) < 500 else [(0, len(w), 18 * 97)]
        want.append((i, found, b" ".join(periodic.collapse(w, found)).decode()))
    assert got == sorted(want, key=repr)
    assert {r[0] for r in got if r[2] == ""} >= {1, 2, 3}


def planted_words(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_planted_runs_are_found(spark):
    rows = [(i, " ".join(f"{i}.{k}" for k in range(150))) for i in range(150)] + [(None, "x " * 40), (3, None), (4, "  ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    made = {(r.doc_id, r.text): r.made for r in frame.select("*", periodic.planted().alias("made")).collect()}
    for i, t in rows:
        assert (made[i, t] or "").encode().split() == planted_words(i, t)
    found = {r.doc_id: r.runs for r in periodic.find(frame.select("doc_id", periodic.planted().alias("text"))).collect() if r.doc_id}
    hit = [i for i in range(150) if found.get(i)]
    assert len(hit) > 5 and all(zlib.crc32(str(i).encode()) % 10 == 0 for i in hit)


def test_digests_of_the_query(spark, small):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        w = planted_words(doc_id, text)
        if len(w) > 1500:
            continue
        found, r = brute_runs(w), got[doc_id]
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(periodic.collapse(w, found))).hexdigest()
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
