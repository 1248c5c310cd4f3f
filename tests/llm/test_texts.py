"""Tokens, language, toxicity and language model: round trips, brute force and held-out rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartwise.llm import bpe, langid, ngrams, packing, parts, toxicity
from cartwise.llm.common import words
from cartwise.llm.eliasfano import EliasFano
from tests.llm.conftest import AWKWARD, frame, sentence


def test_words_follow_the_six_spaces():
    assert words("A\x1cB c d\te\r\nF É") == ["a\x1cb", "c d", "e", "f", "É"]


def test_bpe_round_trip_of_awkward_texts(awkward):
    got = sorted(bpe.round_trip(awkward).collect(), key=repr)
    assert len(got) == len(AWKWARD)
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = []
    for i, t in AWKWARD:
        ids = enc.encode_ordinary(t or "")
        want.append(
            (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        )
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bpe_cuts_do_not_change_ids():
    rank_file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    text = "it's  a 12 34 test,\n\n  of   cuts ... I'll see " * 200 + "  "
    whole = bpe.encoder(rank_file, pattern).encode_ordinary(text)
    for size in (1, 7, 64, 1000):
        assert bpe.encode_text(text, rank_file, pattern, size) == whole
    assert "".join(bpe.pieces(text, 50)) == text


def test_bpe_encode_and_decode_frames(awkward):
    got = bpe.decode(bpe.encode(awkward)).collect()
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in got), key=repr) == sorted(
        ((i, t or "") for i, t in AWKWARD), key=repr
    )


def packed_ids(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_packing_keeps_every_token_once_and_in_order(spark):
    rows = [(i, t) for i, t in dict(AWKWARD).items() if i is not None]
    rows += [(100 + k, ". ".join(sentence(k * 9 + j, 12) for j in range(k))) for k in range(40)]
    got = packing.pack(frame(spark, rows).coalesce(1)).toPandas()
    for doc_id, text in rows:
        ids, parts = packed_ids(text), got[got.doc_id == doc_id].sort_values("start")
        assert (parts.doc_tokens == len(ids)).all() and parts.length.sum() == len(ids)
        at = 0
        for p in parts.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    sizes = got.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding <= 0.05 * got.length.sum()


def test_packing_ids_of_letters_with_marks_and_stops():
    rng = np.random.default_rng(8)
    letters = ["ALİ", "İ", "\u0958", "\ufb1d", "e\u0301", "\u00c9", "Σ", "ß", "abc", "Ａ", "\u1e9e", "\u01c5", "x\u0307", "क"]
    stops = [".", "!", "?", ",", "...", "?!", "", "'s", "1"]
    texts = ["ALİ.", "ALİ", "\u0958!", "\ufb1d,"]
    for _ in range(600):
        parts = rng.integers(1, 6)
        texts.append(
            " ".join("".join(rng.choice(letters, rng.integers(1, 4))) + str(rng.choice(stops)) for _ in range(parts))
        )
    for text in texts:
        ids, _ = packing.tokens_of(text, public_tokenizers.path("word_bpe_49k.json"))
        assert ids.tolist() == packed_ids(text).tolist(), text


def test_packing_counts_repeated_rows_and_empty_tables(awkward, nothing):
    assert packing.pack(nothing).count() == 0
    got = packing.pack(awkward).toPandas()
    assert got[got.doc_id == 4].length.sum() == 2 * len(packed_ids("one"))
    assert got[got.doc_id.isna()].length.sum() == len(packed_ids("One two three")) + 1


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        places = np.unique(rng.integers(1, 60, 12)).tolist()
        costs = rng.integers(0, 5, len(places)).tolist()
        costs[-1] = 0
        length = max(8, int(np.diff([0, *places]).max()))
        got = packing.choose_cuts(places, costs, length)

        def price(cuts, places=places, costs=costs, length=length):
            sizes = np.diff([0, *cuts])
            if (sizes > length).any():
                return math.inf
            return sum(length - int(s) for s in sizes) + sum(costs[places.index(c)] for c in cuts)

        options = [
            [p for k, p in enumerate(places) if bits >> k & 1 or p == places[-1]] for bits in range(1 << (len(places) - 1))
        ]
        assert price(got) == min(map(price, options))


def test_language_of_awkward_texts(spark, awkward, nothing):
    rows = [("en", "the cat and the dog in the house"), ("de", "der hund und die katze in dem haus")] * 3
    model = langid.train(spark.createDataFrame([*rows, (None, "the"), ("fr", None)], "lang string, text string"))
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in langid.predict(awkward, model).collect()}
    assert len(got) < len(AWKWARD) == langid.predict(awkward, model).count()
    for i in (1, 2, 3, 11):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    said = langid.predict(frame(spark, [(1, "the doghouse"), (2, "die hundekatze"), (3, "²")]), model).collect()
    assert [r.lang_pred for r in said] == ["en", "de", "und"]
    empty = langid.train(nothing.select("lang", "text"))
    assert {r.lang_pred for r in langid.predict(awkward, empty).collect()} == {"und"}


def test_language_back_off_takes_the_longest_known_grams():
    model = langid.Model(["a", "b"], {}, np.empty((0, 2), np.float32), {"ab": 0, "b": 1}, np.array([[1, 2], [3, 4]], np.float32), 3)
    assert model.unseen("xabx").tolist() == [1, 2] and model.unseen("b").tolist() == [3, 4]


def test_language_held_out_accuracy(spark, small):
    from cartwise.llm.queries import QUERIES

    got = QUERIES["op1_language_id"](spark, small.replace("0.001", "0.01")).toPandas()
    truth = spark.read.parquet(small.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert (both.lang == both.lang_pred)[both.held_out].mean() >= 0.97


def test_toxicity_learns_terms_and_not_identities(spark, awkward, nothing):
    rows = []
    for k in range(400):
        toxic = k % 4 == 0
        # Toxic texts name one group more often: a plain model would learn the name itself.
        who = "muslim" if (toxic and k % 8) or k % 16 == 3 else "christian"
        rows.append((f"{sentence(k, 8)} {who} {'idiot' if toxic else 'friend'}", int(toxic)))
    labelled = spark.createDataFrame(rows, "text string, toxic int")
    model = toxicity.train(labelled)
    of = lambda t: model.score(toxicity.features(t))
    assert of("you idiot there") >= 0.7 > of("you friend there")
    plain = toxicity.train(labelled, counterfactual=0.0)
    gap = lambda m: abs(m.score(toxicity.features("a muslim friend")) - m.score(toxicity.features("a christian friend")))
    assert gap(model) <= gap(plain) + 1e-9 and gap(model) < 0.1
    got = toxicity.score(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.reject(awkward, model).schema == awkward.schema
    none = toxicity.train(nothing.withColumn("toxic", nothing.n))
    assert all(r.score < 1e-12 for r in toxicity.score(awkward, none).collect())


def test_swapped_terms():
    assert toxicity.swapped("Women and men") == "men and women" and toxicity.swapped("nobody") is None


def test_elias_fano_access_and_successor():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 3), (100, 50), (1000, 10**9), (777, 10**12)):
        values = np.sort(rng.integers(0, top, n))
        ef = EliasFano.build(values)
        assert (ef.get(np.arange(n)).astype(np.int64) == values).all()
        asked = np.concatenate([values, values + 1, rng.integers(0, top + 5, 200)])
        assert (ef.successor(asked) == np.searchsorted(values, asked)).all()


def test_trie_file_and_normalised_probabilities(spark, tmp_path):
    texts = ["a b c a b d", "a b c", "b c a c", "d d a b"]
    model = ngrams.train(spark.createDataFrame([(t,) for t in texts], "text string"), word_share=1e-9, gram_share=1e-9)
    v = model.vocabulary
    path = spark.sparkContext.listFiles
    assert any(model.trie_file in p for p in path)
    from pyspark import SparkFiles

    trie = ngrams.Trie.open(SparkFiles.get(model.trie_file))
    words_ = np.arange(v.start)
    for first in range(v.start + 1):
        for second in range(v.start + 1):
            n = np.full(v.start, 1)
            context = trie.find_pairs(n * first, n * second)
            total = (10 ** trie.log_p(n * second, words_, trie.find_pairs(n * second, words_), context)).sum()
            # Counts of nothing get a tenth; quantising changes little with so few values.
            assert total == pytest.approx(1, abs=0.05)


def test_scores_against_brute_force_base(spark, awkward):
    train = awkward.filter("doc_id <> 6 OR doc_id IS NULL")
    got = ngrams.score(awkward, ngrams.train(train)).collect()
    assert len(got) == len(AWKWARD)
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    counts = Counter(w for i, t in AWKWARD if i != 6 for w in [*split(t), None])
    n, types = sum(counts.values()), len(counts)
    want = []
    for i, t in AWKWARD:
        tokens = [*split(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (types + 1))) for w in tokens)
        want.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 4)))
    shown = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got]
    assert sorted(shown, key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got)
    assert ngrams.score(awkward.limit(0), ngrams.train(train.limit(0))).count() == 0


def test_pairs_and_triples_outside_of_the_trie_count_in_full(spark):
    texts = ["a b c a b d", "a b c", "b c a c", "d d a b", "c b a"]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    asked = spark.createDataFrame([(1, "a b c"), (2, "d d a c"), (2, "d d a c"), (3, "c c c"), (4, ""), (5, "b a d b c a b d")], "doc_id long, text string")
    # 25 tokens: the second share leaves pairs and triples seen fewer than 3 times out of the trie, the third all.
    whole, some, none = (ngrams.train(train, 1e-9, share) for share in (1e-9, 0.1, 0.9))
    assert whole.rest is None and some.rest.count() > 0
    counts = Counter(g for t in texts for w in [["^", *t.split(), "$"]] for k in (1, 2, 3) for g in zip(*(w[i:] for i in range(k)), strict=False))
    total = sum(len(t.split()) + 1 for t in texts)

    def p(gram):
        if len(gram) == 1:
            return counts[gram] / total
        before, seen = gram[:-1], sum(n for g, n in counts.items() if g[:-1] == gram[:-1] and len(g) == len(gram))
        if not seen:
            return p(gram[1:])
        kinds = sum(g[:-1] == before for g in counts if len(g) == len(gram))
        return (max(counts[gram] - 0.75, 0) + 0.75 * kinds * p(gram[1:])) / seen

    want = []
    for r in asked.collect():
        w = ["^", *r.text.split(), "$"]
        want.append((r.doc_id, sum(math.log10(p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(1, len(w)))))
    for model in (whole, some, none):
        got = [(r.doc_id, r.score) for r in ngrams.score(asked, model).collect()]
        assert [i for i, _ in sorted(got)] == [i for i, _ in sorted(want)]
        assert [s for _, s in sorted(got)] == pytest.approx([s for _, s in sorted(want)], abs=1e-6)


def test_grams_of_a_common_middle_word_are_cut(spark):
    train = spark.createDataFrame([(f"{sentence(k, 9)} to a to b to {sentence(k % 3, 4)}",) for k in range(60)], "text string")
    asked = train.limit(20).selectExpr("xxhash64(text) doc_id", "concat(text, ' to a to') text")
    # One part for all, or many, of which some hold a slice of the word "to".
    one, many = (ngrams.train(train, 1e-9, 0.02, part_tokens=n) for n in (10**6, 20))
    assert one.parts.number == 1 and many.parts.cut_parts > 1
    got = [{r.doc_id: r.score for r in ngrams.score(asked, m).collect()} for m in (one, many)]
    assert got[1] == pytest.approx(got[0], abs=1e-9) and len(got[0]) == asked.distinct().count()


def test_grams_take_few_bytes(spark):
    """All that is stored of a corpus without repeats: one pair and one triple per token."""
    rng = np.random.default_rng(5)
    texts = [(" ".join(f"w{i}" for i in rng.integers(0, 3000, 400)),) for _ in range(250)]
    model = ngrams.train(spark.createDataFrame(texts, "text string"), 1e-9, 1e-3)
    assert model.rest.selectExpr("sum(length(blob)) n").first().n < 8 * 100_000


def test_packed_runs_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        keys, counts = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)), rng.integers(1, 1 << 40, n)
        back = parts.unpack(parts.pack(keys, counts, counts / 7), np.int64, np.float64)
        assert all((x == y).all() and len(x) == n for x, y in zip(back, (keys, counts, counts / 7), strict=True))
