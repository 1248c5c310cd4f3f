"""Exact, near, line and passage dedup against brute force, and the search."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from cartwise.llm import exact, fuse, lines, near, passages, topk
from cartwise.llm.common import fold, shingles, word_hashes
from cartwise.llm.components import components, local_components
from tests.llm.conftest import AWKWARD, frame, sentence


def test_fuse_filter_misses_nothing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        blob = fuse.build(np.concatenate([keys, keys[: n // 2]]))
        assert fuse.contains(blob, keys).all()
        others = rng.integers(0, 2**63, 20_000).astype(np.uint64) | np.uint64(1 << 63)
        assert fuse.contains(blob, others).mean() < 0.01
    assert len(blob) < 1.25 * 60_000


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeeze(t)].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        g = groups[squeeze(t)]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[2]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(squeeze(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("early", ["true", "false", "doc_id % 2 = 0"])
def test_exact_dedup_of_awkward_rows(spark, awkward, early):
    from pyspark.sql import functions as F

    got = exact.dedup(awkward, F.expr(early)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == exact_brute(AWKWARD)


def test_exact_dedup_of_nothing(nothing):
    assert exact.dedup(nothing, fold("doc_id", 2) == 0).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    a, b = np.concatenate([a, np.arange(1000, 1100)]), np.concatenate([b, np.arange(1001, 1101)])
    links = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)] + [(None, 3), (7, 7)], "a long, b long")
    proper = a != b
    want = local_components(a[proper], b[proper])
    assert {r.id: r.component for r in components(links).collect()} == want


def test_components_over_many_tasks(spark, monkeypatch):
    import cartwise.llm.components as module

    monkeypatch.setattr(module, "LOCAL_LINKS", 20)
    n = 200
    links = spark.range(n).selectExpr("(id * 37) % 200 AS a", "(id * 37 + 37) % 200 AS b")
    assert {(r.id, r.component) for r in module.components(links).collect()} == {(k, 0) for k in range(n)}


def near_brute(rows, width, percent):
    sets = [frozenset(shingles(word_hashes(t), width).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                parent[find(x)] = find(y)
    groups = defaultdict(list)
    for x in range(len(rows)):
        groups[find(x)].append(rows[x][0])
    out = []
    for x, (i, _) in enumerate(rows):
        ids = [j for j in groups[find(x)] if j is not None]
        component = (min(ids) if ids else None) if sets[x] else i
        out.append((i, len(sets[x]), component, i == component))
    return sorted(out, key=repr)


def test_near_dedup_of_awkward_rows(awkward, nothing):
    got = near.components_of(awkward, 2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == near_brute(AWKWARD, 2, 80)
    assert near.components_of(nothing).count() == 0


def test_near_dedup_of_a_large_group_at_the_threshold(spark):
    rng = np.random.default_rng(11)
    base = sentence(1, 120).split()
    rows = []
    for k in range(150):
        text = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 16)):
            text[at] = f"new{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(text)))
    rows += [(1000 + k, sentence(50 + k, 100)) for k in range(50)]
    got = near.components_of(frame(spark, rows), 2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == near_brute(rows, 2, 80)


def test_posterior_bounds_grow_and_keep_true_pairs():
    steps = near.least_matches(150, 30, 0.8, 1e-6)
    assert [n for n, _ in steps] == [30, 60, 90, 120, 150]
    rng = np.random.default_rng(0)
    alive = np.ones(20_000, bool)
    hits = (rng.random((20_000, 150)) < 0.8).cumsum(axis=1)
    for n, m in steps:
        assert m > 0
        alive &= hits[:, n - 1] >= m
    assert alive.mean() > 0.9999


def line_brute(rows):
    items = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if line:
                items.append((i, k, frozenset(lines.character_shingles(line).tolist())))
    names = sorted({x[2] for x in items}, key=lambda s: sorted(s))
    at = {s: k for k, s in enumerate(names)}
    a, b = [], []
    for x in range(len(names)):
        for y in range(x):
            both = len(names[x] & names[y])
            if 100 * both >= 80 * (len(names[x]) + len(names[y]) - both):
                a.append(x)
                b.append(y)
    parts = local_components(np.array(a, int), np.array(b, int))
    groups = defaultdict(list)
    for i, k, s in items:
        groups[parts.get(at[s], at[s])].append((i is None, i, k))
    first = {g: min(v, key=lambda x: (x[0], x[1] or 0, x[2]))[1:] for g, v in groups.items()}
    return sorted(
        ((i, k, *first[g := parts.get(at[s], at[s])], len(groups[g]), (i, k) == first[g]) for i, k, s in items), key=repr
    )


def test_line_dedup_against_brute_force(spark, nothing):
    rows = [r for r in AWKWARD if r[0] not in (9, 10)]
    rows += [(20 + k, "\n".join([sentence(k % 3, 20) + f" tail{k}", "", "same line here", sentence(k, 9)])) for k in range(12)]
    docs = frame(spark, rows)
    decided = lines.decide(docs)
    got = decided.select("doc_id", "line_no", "first_doc", "first_line", "copies", "kept").collect()
    # Rows that repeat an id and line are one place in the document: kept with the first of them.
    assert sorted(map(tuple, got), key=repr) == line_brute(rows)
    cleaned = {r.doc_id: r.text for r in lines.clean(docs, decided).collect()}
    assert cleaned[20] == rows[-12][1] and "same line here" not in cleaned[21] and cleaned[1] is None
    assert lines.decide(nothing).count() == 0


def test_passages_inside_other_lines_are_found(spark, awkward, nothing):
    passage = sentence(77, 70)
    rows = [(k, f"{sentence(100 + k, 37 + k)} {passage} {sentence(200 + k, 50)}\n{sentence(300 + k, 30)}") for k in range(8)]
    rows += [(50 + k, sentence(500 + k, 90)) for k in range(10)]
    docs = frame(spark, rows)
    found = passages.find(docs)
    assert {r.doc_id for r in found.collect()} == set(range(1, 8))
    cleaned = {r.doc_id: r.text for r in passages.clean(docs, found).collect()}
    whole = dict(rows)
    gone = set(passage.split())
    for k in range(8):
        left = cleaned[k].split()
        assert cleaned[0] == whole[0] and set(whole[k].split()) - gone <= set(left)
        if k:
            assert sum(w in gone for w in left) < 30
    assert all(cleaned[50 + k] == whole[50 + k] for k in range(10))
    assert passages.find(nothing).count() == 0
    got = {(r.doc_id, r.first_doc) for r in passages.find(awkward).collect()}
    assert got == {(7, 6), (8, 6)}
    out = passages.clean(awkward, passages.find(awkward))
    assert out.schema == awkward.schema and out.count() == len(AWKWARD)


def test_paragraph_names_agree():
    hashes = word_hashes(sentence(3, 300))
    starts, sizes, names, _ = passages.paragraphs(hashes)
    assert sizes.sum() == 300 and (sizes[1:-1] > passages.RADIUS).all()
    assert [passages.paragraph_name(hashes[a : a + n]) for a, n in zip(starts, sizes, strict=True)] == names.tolist()


def test_without_spans():
    assert passages.without("a b  c d\ne f", [(1, 2), (4, 1)]) == "a d\nf"


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[50:60] = v[40:50]
    rows = [(k, v[k].tolist(), 1) for k in range(300)]
    rows += [(300, None, 1), (400, [], 1), (500, [1.0, None] + [0.0] * 6, 1), (600, [float("nan")] + [0.0] * 7, 1)]
    rows += [(700, [float("inf")] + [0.0] * 7, 1), (800, [1.0, 2.0], 1), (801, [3.0, 1.0], 1), (None, v[0].tolist(), 1), rows[7]]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    from pyspark.sql import functions as F

    got = topk.search(docs, F.col("vec_id") % 100 == 0, group_rows=20, query_block=2, pivots=6).collect()
    whole = np.floor(1024 * v.astype(np.float64)).astype(np.int64)
    want = [(800, 1, 801, int(np.dot([1024, 2048], [3072, 1024])))]
    for q in (0, 100, 200):
        scores = whole @ whole[q]
        order = [k for k in np.lexsort((np.arange(300), -scores)) if k != q][:10]
        want += [(q, r + 1, int(k), int(scores[k])) for r, k in enumerate(order)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.search(docs.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_search_leaves_candidates_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 800
    v = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 16)) * 20)
    longest = float(np.sqrt((v * v).sum(axis=1).max()))
    pivots = topk.choose_pivots(topk._lift(v[::7], longest), 24)
    index = topk.Index(np.arange(4000), v, pivots, longest)
    ids, scores, seen = index.search(-1, v[5], 10)
    best = np.lexsort((np.arange(4000), -(v @ v[5])))[:10]
    assert ids.tolist() == best.tolist() and seen < 2000


def random_words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 100_000, n)]


def test_exact_passages_go_from_end_to_end(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for k in range(60):
        passage = random_words(rng, 50 + k % 12)
        rows.append((k, " ".join(random_words(rng, 40) + passage + random_words(rng, 30))))
        before, after = random_words(rng, 20 + k % 7), random_words(rng, 25)
        rows.append((100 + k, " ".join(before + passage + after)))
        want[100 + k] = len(before), len(passage)
    docs = frame(spark, rows)
    found = passages.find(docs)
    got = {r.doc_id: (r.start, r.n_words, r.first_doc) for r in found.collect()}
    assert sorted(got) == sorted(want)
    for i, (start, n) in want.items():
        a, size, first = got[i]
        # A paragraph that reaches over an end may be a near copy as a whole.
        assert a <= start and a + size >= start + n and size <= n + 6 and first == i - 100


def test_every_run_of_fifty_words_holds_a_seed():
    rng = np.random.default_rng(12)
    hashes = word_hashes(" ".join(random_words(rng, 2000)))
    at, _ = passages.seeds(hashes)
    for a in range(2000 - passages.EXACT_WORDS + 1):
        assert ((at >= a) & (at + passages.SEED_WORDS <= a + passages.EXACT_WORDS)).any()
    own = passages.run_hashes(hashes, 50)
    assert (passages.run_hashes(hashes[7:], 50) == own[7:]).all() and len(np.unique(own)) == len(own)


def test_edited_paragraphs_are_found_as_a_whole(spark):
    rng = np.random.default_rng(13)
    rows, pairs = [], {}
    for k in range(90):
        n, edits = ((60, 1), (80, 1), (100, 2))[k % 3]
        line = random_words(rng, n)
        rows.append((k, " ".join(random_words(rng, 20)) + "\n" + " ".join(line) + "\n" + " ".join(random_words(rng, 20))))
        changed = list(line)
        for e in range(edits):
            changed[n // (edits + 1) * (e + 1)] = f"edit{k}x{e}"
        p, q = (shingles(word_hashes(" ".join(x)), 5) for x in (line, changed))
        assert 100 * len(np.intersect1d(p, q)) >= 80 * len(np.union1d(p, q))
        rows.append((100 + k, " ".join(random_words(rng, 15)) + "\n" + " ".join(changed)))
        pairs[100 + k] = (15, n)
    found = {(r.doc_id, r.start, r.n_words) for r in passages.find(frame(spark, rows)).collect()}
    # A piece that reaches over an end may be a near copy as a whole; three bands miss 0.8 % at the threshold.
    whole = [(i, a, n) for i, a, n in found if i in pairs and 9 <= a <= 15 and a + n == sum(pairs[i])]
    assert len(whole) >= 86 and len(found) - len(whole) <= 4
    assert all(i >= 100 for i, _, _ in found)


def test_units_are_pieces_and_lines():
    rng = np.random.default_rng(14)
    lines_ = [" ".join(random_words(rng, n)) for n in (30, 10, 40)]
    starts, sizes, names, signatures = passages.units(f"{lines_[0]}\n{lines_[1]}\n\n{lines_[2]}\n")
    assert list(zip(starts.tolist(), sizes.tolist(), strict=True))[-2:] == [(0, 30), (40, 40)]
    assert len(starts) == len(names) == len(signatures)
    hashes = word_hashes(" ".join(lines_))
    assert [passages.paragraph_name(hashes[a : a + n]) for a, n in zip(starts, sizes, strict=True)] == names.tolist()
    assert all(len(x) == 0 for x in (*passages.units(None), *passages.units(" ")))


def test_edited_passages_inside_longer_lines(spark):
    rng = np.random.default_rng(15)
    kinds, rows, pairs = ((60, 1), (80, 1), (100, 2), (150, 3)), [], {}
    for k in range(200):
        n, edits = kinds[k % 4]
        passage = random_words(rng, n)
        changed = list(passage)
        for e, at in enumerate(np.sort(rng.choice(n, edits, replace=False)).tolist()):
            changed[at] = f"edit{k}x{e}"
        p, q = (shingles(word_hashes(" ".join(x)), 5) for x in (passage, changed))
        if 100 * len(np.intersect1d(p, q)) < 80 * len(np.union1d(p, q)):
            continue
        rows.append((k, " ".join(random_words(rng, 40) + passage + random_words(rng, 40))))
        rows.append((1000 + k, " ".join(random_words(rng, 40) + changed + random_words(rng, 40))))
        pairs[1000 + k] = n, edits
    found = passages.find(frame(spark, rows)).collect()
    assert all(r.doc_id in pairs and r.first_doc == r.doc_id - 1000 for r in found)
    for kind in kinds:
        mine = [i for i, x in pairs.items() if x == kind]
        gone = [sum(len(set(range(r.start, r.start + r.n_words)) & set(range(40, 40 + kind[0]))) for r in found if r.doc_id == i) for i in mine]
        assert np.mean(np.array(gone) > 0) >= 0.95 and np.sum(gone) >= 0.9 * kind[0] * len(mine), (kind, gone)
    # A long piece that reaches over an end of the passage may be a near copy as a whole.
    over = [max(40 - r.start, r.start + r.n_words - 40 - pairs[r.doc_id][0]) for r in found]
    assert max(over) <= 8 and np.mean(np.array(over) > 0) < 0.1


def test_extension_over_edits_against_a_plain_walk():
    rng = np.random.default_rng(16)
    for turn in range(300):
        own = rng.integers(0, 10**6, 200).astype(np.uint64)
        other = own.copy()
        at = int(rng.integers(120, 140))
        if turn % 3 == 0:
            other[at] += np.uint64(10**7)
        elif turn % 3 == 1:
            other = np.delete(other, at)
        else:
            other = np.insert(other, at, np.uint64(10**7))
        start, size = passages.extended(own, 60, 50, other[20:60], other[110:150], 80)
        assert start == 20
        ends = {0: 150, 1: 151, 2: 149}[turn % 3]
        room = ends - at - (turn % 3 < 2)
        assert start + size == (ends if room >= passages.WIDTH else at), (turn, at)


def test_passages_of_rows_without_ids_of_their_own(spark):
    rng = np.random.default_rng(17)
    passage = random_words(rng, 70)
    texts = [" ".join(random_words(rng, 90)) for _ in range(40)]
    twice = " ".join(random_words(rng, 30) + passage)
    rows = [(None, t) for t in texts] + [(None, twice), (None, twice), (3, " ".join(passage + random_words(rng, 20))), (3, texts[0] + " x")]
    docs = frame(spark, rows)
    found = passages.find(docs)
    out = [(r.doc_id, r.text) for r in passages.clean(docs, found).collect()]
    assert len(out) == len(rows)
    assert all((None, t) in out for t in texts[1:]) and all(r in out for r in rows[-2:])
    assert not any(i is None and " ".join(passage) in t for i, t in out)
    assert (None, texts[0]) not in out


def test_cleaning_keeps_columns_with_clashing_names(spark):
    rng = np.random.default_rng(18)
    text = " ".join(random_words(rng, 60))
    docs = spark.createDataFrame(
        [(1, text, "a", "b", "c", "d"), (2, text, "a", "b", "c", "d")],
        "doc_id long, text string, cut_id string, cuts string, cut_text string, text_id string",
    )
    out = {r.doc_id: r for r in passages.clean(docs, passages.find(docs)).collect()}
    assert out[1].text == text and out[2].text == "" and out[2].cuts == "b" and out[2].text_id == "d"


def test_signatures_and_sets_of_many_lines_are_those_of_each():
    rng = np.random.default_rng(2)
    some = ["".join(rng.choice(list("ab cé\U0001f600\ud800"), n)).strip() or "x" for n in rng.integers(1, 60, 300)] + ["a" * 50, "b" * 40_000, "c"]
    family = lines._family()
    got = np.concatenate([family.signatures(*lines.runs_of(part)) for part in lines._chunks(some)])
    assert (got == np.stack([family.signature(lines.character_runs(x)) for x in some])).all()
    for one, many in zip(map(lines.character_shingles, some), lines.character_sets(some), strict=True):
        assert one.tolist() == many.tolist()
    assert lines.character_sets([]) == []
