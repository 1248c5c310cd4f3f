"""Language model scoring with a compact n-gram trie.

Training counts all words of all training texts. Words whose share reaches ``WORD_SHARE`` have ids of
their own; every other word is one of a class of rare words with the same last letters (classes below
that share fall together). All pairs and triples of ids are counted over all texts, combined before
they are shuffled, and all belong to the model. Those whose share reaches ``GRAM_SHARE`` go into the
trie; shares add up to one, so each of its levels has at most ``1 / share`` entries, however large the
corpus is. The rest stays in packed runs (see ``parts``) that grow with the corpus and are never in one place.

Probabilities are interpolated with absolute discounting; what is discounted from all of a context's
successors is its weight for the shorter context. A rare word has its class's probability in context,
times its own smoothed share of the class, which is looked up in parts of all words, so that no table of all
words is sent anywhere. Pairs and triples outside of the trie are looked up in their parts in the same pass: a part
tells what each adds to the logarithm that its text gets without it, so their sums by text are exact.

The trie has a level per n-gram length. A level's entries are grouped by context; monotone pointers
delimit the groups. A pair's last word is its id; a triple's last word is its place among the
successors of the triple's middle word. Both are made monotone by adding what came before, and are
Elias-Fano coded. Logarithms of probabilities and weights are quantised to ``LEVELS`` values each.
The levels are one file in the shared folder that executors fetch once and map into memory.

Defined cases: null texts count as empty; an empty text is its end token alone. Rows that repeat id
and text have equal scores, each gives a row. Without any training token every score is that of an
empty vocabulary. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.llm.common import words
from cartwise.llm.eliasfano import EliasFano
from cartwise.llm.parts import BITS, NONE, RUN_KEYS, Parts, dealt, gram, heads_of, merged, pack, places, summed, ungram, unpack
from cartwise.session import materialize, scratch_path

WORD_SHARE, GRAM_SHARE, DISCOUNT, LEVELS, SUFFIX = 1e-6, 1e-6, 0.75, 256, 3
#: The end token and the class of all other rare words; neither can be a word.
END, RARE = " ", "\t"
_FLUSH_WORDS, _FLUSH_GRAMS, _FLUSH_SCORED = 500_000, 4_000_000, 500_000
#: Tokens whose grams one part holds, and the fewest for which a part of its own pays.
PART_TOKENS, LEAST_PART_TOKENS = 3_000_000, 200_000
#: Stored grams of a part that are worked out together, or all of a word.
_REST_KEYS = 500_000


def rare_class(word: str) -> str:
    """Rare words are told apart by their last letters."""
    return RARE + word.rstrip(".,;:!?|")[-SUFFIX:]


def _count_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    for batch in it:
        for text in batch.column("text"):
            counts.update(words(text.as_py() or ""))
            counts[END] += 1
            if len(counts) > _FLUSH_WORDS:
                yield out()
                counts.clear()
    if counts:
        yield out()


@dataclass
class Vocabulary:
    """Ids of frequent words and of classes; the id after the last one stands for a text's start."""

    ids: dict[str, int]
    counts: np.ndarray  # of each id
    rare_mass: np.ndarray  # of each id: log10 of a class's smoothed mass, 0 for words
    total: int
    distinct: int
    words: int  # ids below are words

    @property
    def start(self) -> int:
        return len(self.counts)

    @property
    def context_counts(self) -> np.ndarray:
        """How often each id stands before another one; texts start as often as they end."""
        return np.append(self.counts, self.counts[self.ids[END]]).astype(np.float64)


def _vocabulary(counts: DataFrame, word_share: float) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(2, math.ceil(word_share * total))
    frequent = counts.filter((F.col("n") >= least) | (F.col("word") == END)).toPandas()
    if END not in set(frequent["word"]):  # nothing to learn from
        frequent = pd.DataFrame({"word": [END], "n": [0]})
    frequent = frequent.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)

    def classes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            names = [rare_class(w) for w in batch.column("word").to_pylist()]
            yield pa.record_batch([pa.array(names, pa.string()), batch.column("n")], names=["name", "n"])

    rare = (
        counts.filter((F.col("n") < least) & (F.col("word") != END))
        .mapInArrow(classes, "name string, n long")
        .groupBy("name")
        .agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    )
    rare = materialize(rare, "rare-classes")
    own = rare.filter((F.col("n") >= least) & (F.col("name") != RARE)).orderBy("name").toPandas()
    other = (
        rare.filter((F.col("n") < least) | (F.col("name") == RARE))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("types"))
        .first()
    )
    names = [*frequent["word"], *own["name"], RARE]
    n = np.array([*frequent["n"], *own["n"], other["n"]], np.int64)
    # A class's smoothed mass: its words' counts and one tenth for each, and for one unseen word.
    mass = np.concatenate(
        [np.ones(len(frequent)), own["n"] + 0.1 * own["types"] + 0.1, [other["n"] + 0.1 * other["types"] + 0.1]]
    )
    return Vocabulary(
        {w: k for k, w in enumerate(names)}, n, np.log10(mass.astype(np.float64)), int(total), int(distinct), len(frequent)
    )


class _Ids(dict):
    """Id of each word, rare ones by class; remembered per worker."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__({w: k for w, k in vocabulary.ids.items() if k < vocabulary.words and w != END})
        self.ids, self.own = vocabulary.ids, len(self)
        self.other = vocabulary.ids[RARE]

    def __missing__(self, word: str) -> int:
        if len(self) > self.own + _FLUSH_WORDS:
            for w in list(self)[self.own :]:
                del self[w]
        k = self[word] = self.ids.get(rare_class(word), self.other)
        return k

    def of(self, tokens: list[str]) -> np.ndarray:
        """Ids of a text's words and of its end."""
        out = np.empty(len(tokens) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        out[-1] = self.ids[END]
        return out


_HELD: dict = {}


def _held(key, make):
    """One value per worker and kind, replaced when the key changes."""
    kind = key[0]
    if _HELD.get(kind, (None,))[0] != key:
        _HELD[kind] = (key, make())
    return _HELD[kind][1]


def _count_grams(vocabulary, parts: Parts, name: str):
    """Packed counts of grams per part, combined per few million of them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _held(("ids", name), lambda: _Ids(vocabulary.value))
        start = vocabulary.value.start
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            before, middle, _ = ungram(keys)
            found = [(p, pack(keys[at], n[at].astype(np.int64))) for p, at in dealt(parts.of(before, middle))]
            return pa.record_batch(
                [pa.array([p for p, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["part", "blob"]
            )

        for batch in it:
            for text in batch.column("text"):
                row = ids.of(words(text.as_py() or ""))
                before = np.concatenate([[start], row[:-1]])
                held.append(gram(before, row, np.append(row[1:], NONE)))
                size += len(row)
                if size >= _FLUSH_GRAMS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


#: What a row of the table of grams is: packed grams of a part, a frequent pair or triple, how many kinds of words
#: come behind an id, or the pairs that begin with a word whose grams are cut into slices.
GRAMS, PAIR, TRIPLE, FOLLOWERS, SLICED = range(1, 6)
_GRAM_TABLE = "kind int, part int, key long, n long, followers long, blob binary"


def _sum_grams(parts: Parts, least: int):
    """The rows of one part."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        keys, n = merged(x.as_py() for x in table.column("blob"))
        before, middle, behind = ungram(keys)
        heads = heads_of(keys >> np.uint64(BITS))
        inner = behind != NONE
        pair_n, followers = np.add.reduceat(n, heads), np.add.reduceat(inner.astype(np.int64), heads)
        pair = (before[heads] << BITS) | middle[heads]
        often, often3 = pair_n >= least, inner & (n >= least)
        triple = (before[often3] << (2 * BITS)) | (middle[often3] << BITS) | behind[often3]
        ids, seconds = np.unique(before[heads], return_counts=True)
        rows = [
            (PAIR, pair[often], pair_n[often], followers[often]),
            (TRIPLE, triple, n[often3], np.zeros(len(triple), np.int64)),
            (FOLLOWERS, ids, seconds, np.zeros(len(ids), np.int64)),
        ]
        blobs = []
        if least > 1:
            blobs += [(GRAMS, part, pack(keys[a : a + RUN_KEYS], n[a : a + RUN_KEYS])) for a in range(0, len(keys), RUN_KEYS)]
            if part < parts.cut_parts:
                blobs.append((SLICED, int(middle[0]), pack(*summed(behind[inner].astype(np.uint64), n[inner]))))
        size, m = sum(len(r[1]) for r in rows), len(blobs)
        kinds = np.concatenate([np.full(len(r[1]), r[0]) for r in rows] + [np.array([b[0] for b in blobs], np.int64)])
        keys, n, followers = (
            np.concatenate([r[c] for r in rows] + [np.array([b[1] * (c == 1) for b in blobs], np.int64)]) for c in (1, 2, 3)
        )
        return pa.table(
            {
                "kind": pa.array(kinds.astype(np.int32)),
                "part": pa.array(np.full(size + m, part, np.int32)),
                "key": pa.array(keys),
                "n": pa.array(n),
                "followers": pa.array(followers),
                "blob": pa.concat_arrays([pa.nulls(size, pa.binary()), pa.array([b[2] for b in blobs], pa.binary())]),
            }
        )

    return run


def _share_slices(parts: Parts):
    """The pairs that begin with a word, added up, for each part that has a slice of the word's grams."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        word = key[0].as_py()
        blob = pack(*merged(x.as_py() for x in table.column("blob")))
        first, k = int(parts.first[word]), int(parts.slices[word])
        return pa.table({"part": pa.array(range(first, first + k), pa.int32()), "blob": pa.array([blob] * k, pa.binary())})

    return run


def quantise(values: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook): bins of equal numbers of values, each shown by its mean."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1)
    order = np.argsort(values, kind="stable")
    codes = np.empty(len(values), np.uint8)
    codes[order] = np.arange(len(values)) * levels // len(values)
    sums, sizes = np.bincount(codes, values, levels), np.bincount(codes, minlength=levels)
    return codes, sums / np.maximum(sizes, 1)


def _left_over(followers: np.ndarray, n: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """The weight of the shorter context: what is taken off all successors of a context seen ``n`` times."""
    return np.where(followers > 0, np.clip(discount * followers / np.maximum(n, 1), 1e-9, 1), 1.0)


def _weight(
    context: np.ndarray, share: np.ndarray, kept_n: np.ndarray, followers: np.ndarray, n: np.ndarray, discount: float
) -> np.ndarray:
    """The same of contexts seen ``n`` times, some of whose successors are kept: their shares are taken off one by
    one, those of the rest by their sums."""
    rest_n = n - np.bincount(context, kept_n, len(n))
    rest = rest_n - discount * (followers - np.bincount(context, minlength=len(n)))
    taken = np.bincount(context, share, len(n)) + np.where(followers > 0, rest, 0) / np.maximum(n, 1)
    return np.clip(1 - taken, 1e-9, 1)


@dataclass
class Level:
    """One n-gram length: groups of successors, their quantised probabilities and weights."""

    pointers: EliasFano
    successors: EliasFano
    probability: np.ndarray
    probability_book: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint8))
    weight_book: np.ndarray = field(default_factory=lambda: np.zeros(1))

    @cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each group begins, and what was added to its successors; decoded once per process."""
        heads = self.pointers.get(np.arange(self.pointers.n)).astype(np.int64)
        base, inner = np.zeros(len(heads), np.int64), heads > 0
        base[inner] = self.successors.get(heads[inner] - 1).astype(np.int64) + 1
        return heads, base


def _level(group: np.ndarray, groups: int, last: np.ndarray, log_p: np.ndarray) -> Level:
    """``group`` ascends; within one, ``last`` ascends strictly."""
    pointers = np.searchsorted(group, np.arange(groups + 1))
    heads = np.flatnonzero(np.r_[True, np.diff(group) != 0]) if len(group) else np.empty(0, np.int64)
    tails = np.append(heads[1:], len(group)) - 1 if len(group) else heads
    # Every group starts one above the value before it.
    lift = np.concatenate([[0], np.cumsum(last[tails] + 1)[:-1]]) if len(group) else heads
    values = last + np.repeat(lift, tails - heads + 1) if len(group) else last
    codes, book = quantise(log_p)
    return Level(EliasFano.build(pointers), EliasFano.build(values), codes, book)


class Trie:
    """Two levels above the single words, queried with arrays of contexts and words."""

    def __init__(self, unigram: np.ndarray, unigram_weight: np.ndarray, two: Level, three: Level):
        self.unigram, self.unigram_weight, self.two, self.three = unigram, unigram_weight, two, three

    @classmethod
    def build(
        cls,
        vocabulary: Vocabulary,
        followers: np.ndarray,
        pairs: np.ndarray,
        pair_n: np.ndarray,
        pair_followers: np.ndarray,
        triples: np.ndarray,
        triple_n: np.ndarray,
        discount: float = DISCOUNT,
    ) -> Trie:
        """From sorted pair and triple keys with their counts; ``followers`` counts the kinds of successors of
        each id and pair, kept or not."""
        size, mask = vocabulary.start + 1, (1 << BITS) - 1
        total = max(vocabulary.total, 1)
        single = np.maximum(vocabulary.counts, 0.1) / total
        with np.errstate(divide="ignore"):
            unigram = np.log10(np.append(single, 1.0))
        context_n = vocabulary.context_counts
        a, b = pairs >> BITS, pairs & mask
        share = np.maximum(pair_n - discount, 0) / np.maximum(context_n[a], 1)
        weight1 = _weight(a, share, pair_n, followers, context_n, discount)
        p2 = share + weight1[a] * single[b]
        two = _level(a, size, b, np.log10(p2))
        # A triple's context is a pair; its last word is the place among the middle word's successors.
        context = np.searchsorted(pairs, triples >> BITS)
        tail = np.searchsorted(pairs, triples & ((1 << (2 * BITS)) - 1))
        first = np.searchsorted(a, np.arange(size + 1))
        middle = (triples >> BITS) & mask
        share = np.maximum(triple_n - discount, 0) / np.maximum(pair_n[context], 1) if len(triples) else np.empty(0)
        weight2 = _weight(context, share, triple_n, pair_followers, pair_n, discount)
        p3 = share + weight2[context] * p2[tail] if len(triples) else np.empty(0)
        three = _level(context, len(pairs), tail - first[middle], np.log10(p3))
        two.weight, two.weight_book = quantise(np.log10(weight2))
        return cls(unigram, np.log10(weight1), two, three)

    @staticmethod
    def _find(level: Level, group: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Place of ``last`` among the successors of ``group``, -1 where it is not kept."""
        if not level.successors.n:
            return np.full(len(group), -1, np.int64)
        heads, base = level.groups
        out = np.full(len(group), -1, np.int64)
        some = np.flatnonzero(heads[group] < heads[group + 1])
        want = base[group[some]] + last[some]
        at = level.successors.successor(want.astype(np.uint64))
        ok = (at >= heads[group[some]]) & (at < heads[group[some] + 1])
        ok[ok] = level.successors.get(at[ok]).astype(np.int64) == want[ok]
        out[some[ok]] = at[ok]
        return out

    def find_pairs(self, second: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of pairs, -1 where one is not kept; equal pairs are looked up once."""
        keys, back = np.unique((second << BITS) | word, return_inverse=True)
        return self._find(self.two, keys >> BITS, keys & ((1 << BITS) - 1))[back]

    def log_p(self, second: np.ndarray, word: np.ndarray, pair: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10 probability of ``word`` behind ``second``.

        ``pair`` is the place of these two and ``context`` that of ``second`` with the word before it,
        both from ``find_pairs``.
        """
        return self.log_p_found(second, word, pair, context)[0]

    def log_p_found(
        self, second: np.ndarray, word: np.ndarray, pair: np.ndarray, context: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """``log_p`` and whether it comes from a triple."""
        out = self.unigram_weight[second] + self.unigram[word]
        hit = pair >= 0
        out[hit] = self.two.probability_book[self.two.probability[pair[hit]]]
        longer = context >= 0
        rows = np.flatnonzero(hit & longer)
        place = np.full(len(word), -1, np.int64)
        if len(rows):
            keys, back = np.unique((context[rows] << 32) | pair[rows], return_inverse=True)
            c, q = keys >> 32, keys & 0xFFFFFFFF
            middle = np.empty(len(keys), np.int64)
            middle[back] = second[rows]
            place[rows] = self._find(self.three, c, q - self.two.groups[0][middle])[back]
        found = place >= 0
        shorter = longer & ~found
        out[shorter] += self.two.weight_book[self.two.weight[context[shorter]]]
        out[found] = self.three.probability_book[self.three.probability[place[found]]]
        return out, found

    def to_bytes(self) -> bytes:
        """A header and the arrays, each at a multiple of eight bytes."""
        arrays, sequences = {"unigram": self.unigram, "unigram_weight": self.unigram_weight}, {}
        for name, level in (("two", self.two), ("three", self.three)):
            for part in ("pointers", "successors"):
                ef = getattr(level, part)
                sequences[f"{name}.{part}"] = ef.meta
                arrays |= {f"{name}.{part}.{k}": x for k, x in enumerate(ef.parts)}
            for part in ("probability", "probability_book", "weight", "weight_book"):
                arrays[f"{name}.{part}"] = getattr(level, part)
        places, at, body = {}, 0, []
        for key, x in arrays.items():
            raw = np.ascontiguousarray(x).tobytes()
            places[key] = (at, x.dtype.str, len(x))
            raw += b"\0" * (-len(raw) % 8)
            body.append(raw)
            at += len(raw)
        head = json.dumps({"places": places, "sequences": sequences}).encode()
        head += b" " * (-len(head) % 8)
        return len(head).to_bytes(8, "little") + head + b"".join(body)

    @classmethod
    def open(cls, path: str) -> Trie:
        """Map a file of ``to_bytes``; nothing is read before it is used."""
        data = np.memmap(path, np.uint8, "r")
        size = int(data[:8].view("<u8")[0])
        head = json.loads(bytes(data[8 : 8 + size]))

        def array(key: str) -> np.ndarray:
            at, kind, n = head["places"][key]
            at += 8 + size
            return data[at : at + n * np.dtype(kind).itemsize].view(kind)

        def level(name: str) -> Level:
            sequences = [
                EliasFano(*head["sequences"][f"{name}.{part}"], *(array(f"{name}.{part}.{k}") for k in range(3)))
                for part in ("pointers", "successors")
            ]
            rest = [array(f"{name}.{part}") for part in ("probability", "probability_book", "weight", "weight_book")]
            return Level(*sequences, *rest)

        return cls(array("unigram"), array("unigram_weight"), level("two"), level("three"))


@dataclass
class Model:
    """The vocabulary, the name of the trie's file, the table of all words' counts, the parts of the grams and their
    packed runs (kind, part, blob), None where the trie holds all grams, and the count from which the trie holds one."""

    vocabulary: Vocabulary
    trie_file: str
    counts: DataFrame
    parts: Parts
    rest: DataFrame | None
    least: int


def _share_file(spark: SparkSession, data: bytes) -> str:
    """Put a file into the shared folder and have every executor fetch it; gives its name."""
    name = f"trie-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "trie") + "/" + name)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        for a in range(0, len(data), 1 << 22):
            stream.write(bytearray(data[a : a + (1 << 22)]))
    finally:
        stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def train(
    texts: DataFrame, word_share: float = WORD_SHARE, gram_share: float = GRAM_SHARE, part_tokens: int | None = None
) -> Model:
    """Learn from every row of ``texts`` (text).

    A part holds the grams of about ``part_tokens`` tokens. Unless told otherwise there are two parts a core
    at least, none of them tiny.
    """
    spark = texts.sparkSession
    rows = texts.select("text")
    counts = materialize(
        rows.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts"
    )
    vocabulary = _vocabulary(counts, word_share)
    shared, name = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    least = max(1, math.ceil(gram_share * vocabulary.total))
    if part_tokens is None:
        even = -(-vocabulary.total // (2 * spark.sparkContext.defaultParallelism))
        part_tokens = min(max(even, LEAST_PART_TOKENS), PART_TOKENS)
    parts = Parts(vocabulary.counts, part_tokens)
    grams = (
        rows.mapInArrow(_count_grams(shared, parts, name), "part int, blob binary")
        .groupBy("part")
        .applyInArrow(_sum_grams(parts, least), _GRAM_TABLE)
    )
    grams = materialize(grams, "grams")
    by_id = grams.filter(F.col("kind") == FOLLOWERS).groupBy("key").agg(F.sum("n").alias("f")).toPandas()
    followers = np.zeros(vocabulary.start + 1)
    followers[by_id["key"].to_numpy(np.int64)] = by_id["f"]
    # At most 1 / gram_share rows each.
    two = grams.filter(F.col("kind") == PAIR).select("key", "n", "followers").toPandas().sort_values("key")
    three = grams.filter(F.col("kind") == TRIPLE).select("key", "n").toPandas().sort_values("key")
    trie = Trie.build(
        vocabulary,
        followers,
        two["key"].to_numpy(np.int64),
        two["n"].to_numpy(np.float64),
        two["followers"].to_numpy(np.float64),
        three["key"].to_numpy(np.int64),
        three["n"].to_numpy(np.float64),
    )
    rest = None
    if least > 1:
        rest = grams.filter(F.col("kind") == GRAMS).select("kind", "part", "blob")
        if parts.cut_parts:
            sliced = grams.filter(F.col("kind") == SLICED).groupBy("key").applyInArrow(_share_slices(parts), "part int, blob binary")
            rest = rest.unionByName(materialize(sliced, "sliced").select(F.lit(SLICED).alias("kind"), "part", "blob"))
    return Model(vocabulary, _share_file(spark, trie.to_bytes()), counts, parts, rest, least)


class _Rest:
    """What the grams of one part that are not in the trie add to the logarithms found in the trie.

    A pair changes the probability of its last word and, as a context, that of the word behind it; a
    triple changes that of its last word only. A text's triple that is not in the trie asks for both, as its
    first pair is followed by that triple alone; a pair at a text's end asks as a triple with ``NONE``.
    """

    def __init__(self, facts: tuple, least: int, runs: Iterable[bytes], sliced: Iterable[bytes]):
        found = sorted((unpack(r, np.int64) for r in runs), key=lambda f: f[0][0])
        self.keys = np.concatenate([np.empty(0, np.uint64), *[f[0] for f in found]])
        n = np.concatenate([np.empty(0, np.int64), *[f[1] for f in found]])
        del found
        # A sliced word has a part of its own: the counts of the pairs that it begins, over all slices.
        ends = merged(sliced)
        self.triple_delta, pairs, deltas = np.zeros(len(n)), [], []
        unit = np.uint64(BITS if len(ends[0]) else 2 * BITS)  # what must not be torn apart: a pair, or all of a word
        bounds = heads_of(self.keys >> unit)
        bounds = np.append(bounds[np.unique(np.searchsorted(bounds, np.arange(0, len(n), _REST_KEYS)))[:-1]] if len(n) > _REST_KEYS else bounds[:1], len(n))
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            self._add(facts, least, slice(x, y), n[x:y], ends, pairs, deltas)
        self.pairs = np.concatenate([np.empty(0, np.uint64), *pairs])
        self.pair_delta = np.concatenate([np.empty(0), *deltas])

    def _add(self, facts: tuple, least: int, at: slice, n: np.ndarray, ends: tuple, pairs: list, deltas: list) -> None:
        """What the grams at some places add."""
        context_n, unigram, weight = facts

        def log_p(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.log10((n - DISCOUNT) / np.maximum(context_n[a], 1) + 10 ** (weight[a] + unigram[b]))

        keys = self.keys[at]
        before, middle, behind = ungram(keys)
        heads = heads_of(keys >> np.uint64(BITS))
        inner = behind != NONE
        pair_n, kinds = np.add.reduceat(n, heads), np.add.reduceat(inner.astype(np.int64), heads)
        longer = np.log10(_left_over(kinds, pair_n))
        a, b = before[heads], middle[heads]
        pairs.append(keys[heads] >> np.uint64(BITS))
        deltas.append(np.where(pair_n < least, log_p(pair_n, a, b) - weight[a] - unigram[b] + longer, 0.0))
        few = np.flatnonzero(inner & (n < least))
        if not len(few):
            return
        of_pair = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(n))))[few]
        end = behind if len(ends[0]) else (middle << BITS) | behind
        known, end_n = ends if len(ends[0]) else summed(end[inner].astype(np.uint64), n[inner])
        end_n = end_n[places(known, end[few].astype(np.uint64))[1]]
        lower = longer[of_pair] + log_p(end_n, middle[few], behind[few])
        self.triple_delta[few + at.start] = np.log10((n[few] - DISCOUNT) / pair_n[of_pair] + 10**lower) - lower

    def of(self, asked: np.ndarray) -> np.ndarray:
        """The sum of both for sorted grams; nothing for what was never seen."""
        out = np.zeros(len(asked))
        for known, delta, keys in ((self.pairs, self.pair_delta, asked >> np.uint64(BITS)), (self.keys, self.triple_delta, asked)):
            found, at = places(known, keys)
            out[found] += delta[at[found]]
        return out


#: What a row of ``_score_rows`` is: a batch's documents, or packed grams or words to be looked up for them. Packed
#: words and what was found are rows like these.
DOCUMENTS, ASKED, WORDS, FOUND = range(6, 10)
_ROWS = "kind int, part int, batch long, blob binary"


def _score_rows(vocabulary, trie_file: str, parts: Parts, word_parts: int, has_rest: bool):
    """Per batch a row with its documents, and one per part with the grams outside of the trie, or the rare words, that
    are looked up there for them. A batch is known by its partition and number, so the same partitions must come again
    if they are read again."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        ids = _held(("ids", trie_file), lambda: _Ids(v))
        trie = _held(("trie", trie_file), lambda: Trie.open(SparkFiles.get(trie_file)))
        scale = math.log10(v.total + 0.1 * (v.distinct + 1)) if v.total else math.log10(0.1)
        known = np.zeros(v.start + 1, bool)
        known[: v.words] = v.counts[: v.words] > 0
        base_of = np.zeros(v.start + 1)
        base_of[: v.words] = np.log10(v.counts[: v.words] + 0.1) - scale
        number = TaskContext.get().partitionId() << 32

        def out(part: pa.RecordBatch, texts: list[list[str]]) -> pa.RecordBatch:
            rows = [ids.of(t) for t in texts]
            size = np.array([len(r) for r in rows])
            word = np.concatenate(rows)
            heads = np.concatenate([[0], np.cumsum(size)[:-1]])
            second = np.concatenate([[v.start], word[:-1]])
            second[heads] = v.start
            pair = trie.find_pairs(second, word)
            context = np.concatenate([[-1], pair[:-1]])  # what stood one place before
            context[heads] = -1
            log_p, found = trie.log_p_found(second, word, pair, context)
            rare = (word >= v.words) & (word < v.start)
            log_p -= np.where(rare, v.rare_mass[np.minimum(word, v.start - 1)], 0)
            at_row = np.repeat(np.arange(len(rows)), size)
            docs = pa.record_batch(
                [
                    part.column("doc_id"),
                    pa.array(size.astype(np.int64)),
                    pa.array(np.add.reduceat(known[word].astype(np.int64), heads)),
                    pa.array(np.add.reduceat(np.where(rare, -scale, base_of[word]), heads)),
                    pa.array(np.add.reduceat(log_p, heads)),
                ],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema) as stream:
                stream.write_batch(docs)
            # Documents pass the parts by; a part of their own spreads them.
            made = [(DOCUMENTS, -1 - number % parts.number, sink.getvalue().to_pybytes())]

            def ask(kind: int, keys: np.ndarray, rows_: np.ndarray, part_of: np.ndarray) -> None:
                order = np.argsort(keys, kind="stable")
                keys, rows_ = keys[order], rows_[order].astype(np.uint32)
                made.extend((kind, p, pack(keys[at], rows_[at])) for p, at in dealt(part_of[order]))

            places_ = np.flatnonzero(rare).tolist()
            if places_:
                flat = [w for t in texts for w in (*t, END)]
                names = np.array([xxhash.xxh64_intdigest(flat[i].encode("utf-8", "surrogatepass"), 42) for i in places_], np.uint64)
                ask(WORDS, names, at_row[places_], parts.number + _word_part(names, word_parts))
            if has_rest:
                inner = np.ones(len(word), bool)
                inner[heads] = False
                longest = np.flatnonzero(inner & ~found)
                last = np.append(heads[1:], len(word)) - 1
                last = last[pair[last] < 0]
                before = np.concatenate([second[longest - 1], second[last]])
                middle = np.concatenate([second[longest], word[last]])
                behind = np.concatenate([word[longest], np.full(len(last), NONE)])
                at = np.concatenate([at_row[longest], at_row[last]])
                ask(ASKED, gram(before, middle, behind), at, parts.of(before, middle))
            kinds, where, blobs = zip(*made, strict=True)
            columns = [pa.array(kinds, pa.int32()), pa.array(where, pa.int32()), pa.array([number] * len(made), pa.int64())]
            return pa.record_batch([*columns, pa.array(blobs, pa.binary())], names=["kind", "part", "batch", "blob"])

        for batch in it:
            start, texts, held = 0, [], 0
            for k, text in enumerate(batch.column("text")):
                texts.append(words(text.as_py() or ""))
                held += len(texts[-1]) + 1
                if held >= _FLUSH_SCORED:
                    yield out(batch.slice(start, k + 1 - start), texts)
                    start, texts, held = k + 1, [], 0
                    number += 1
            if texts:
                yield out(batch.slice(start), texts)
                number += 1

    return run


def _word_part(names: np.ndarray, word_parts: int) -> np.ndarray:
    return (names % np.uint64(word_parts)).astype(np.int64)


def _pack_words(first: int, word_parts: int):
    """Packed (name, count) of words per part."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            names, n = summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            found = [(first + p, pack(names[at], n[at])) for p, at in dealt(_word_part(names, word_parts))]
            return pa.record_batch(
                [pa.array([p for p, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["part", "blob"]
            )

        for batch in it:
            held.append((batch.column("name").to_numpy().view(np.uint64), batch.column("n").to_numpy()))
            size += batch.num_rows
            if size >= _FLUSH_WORDS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _look_up(shared, least: int):
    """The rows of one part of grams or words, and what batches ask of it: per batch the sums by document."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        by_kind: dict[int, list] = {}  # what is stored under the negative of its kind
        for kind, batch, blob in zip(table.column("kind").to_pylist(), table.column("batch").to_pylist(), table.column("blob"), strict=True):
            by_kind.setdefault(kind if batch is not None else -kind, []).append((batch, blob))
        out = [(DOCUMENTS, batch, blob.as_py()) for batch, blob in by_kind.get(DOCUMENTS, [])]

        def answer(kind: int, value) -> None:
            for batch, blob in by_kind.get(kind, []):
                asked, row = unpack(blob.as_py(), np.uint32)
                at, back = np.unique(row, return_inverse=True)
                given, known = value(asked)
                sums = np.bincount(back, given, len(at))
                some = (sums != 0) if known is None else np.ones(len(at), bool)
                seen = np.zeros(len(at)) if known is None else np.bincount(back, known, len(at))
                out.append((FOUND if known is None else WORDS, batch, pack(at[some].astype(np.uint64), sums[some], seen[some].astype(np.uint32))))

        if ASKED in by_kind:
            runs, sliced = ((blob.as_py() for _, blob in by_kind.get(-kind, [])) for kind in (GRAMS, SLICED))
            rest = _Rest(shared.value, least, runs, sliced)
            answer(ASKED, lambda asked: (rest.of(asked), None))
        if WORDS in by_kind:
            names, n = merged(blob.as_py() for _, blob in by_kind.get(-WORDS, []))

            def counted(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                found, at = places(names, asked)
                c = np.where(found, n[at], 0) if len(names) else np.zeros(len(asked), np.int64)
                return np.log10(c + 0.1), c > 0

            answer(WORDS, counted)
        kinds, batches, blobs = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({"kind": pa.array(kinds, pa.int32()), "batch": pa.array(batches, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _put_together(total: int):
    """The documents of one batch with all that was found for them."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("kind").to_pylist(), table.column("blob"), strict=True))
        docs = next(pa.ipc.open_stream(blob.as_py()).read_all() for kind, blob in rows if kind == DOCUMENTS)
        known, base, score = (docs.column(c).to_numpy().copy() for c in ("n_known", "base_score", "score"))
        for kind, blob in rows:
            if kind != DOCUMENTS:
                at, sums, seen = unpack(blob.as_py(), np.float64, np.uint32)
                at = at.astype(np.int64)
                score[at] += sums
                if kind == WORDS:
                    base[at] += sums
                    known[at] += seen
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_tokens": docs.column("n_tokens"),
                "n_known": known,
                "train_tokens": np.full(len(known), total, np.int64),
                "base_score": base,
                "score": score,
            }
        )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    Columns: doc_id, n_tokens, n_known, train_tokens, base_score, score.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    v, parts, context = model.vocabulary, model.parts, docs.sparkSession.sparkContext
    word_parts = max(1, -(-v.distinct // PART_TOKENS))
    run = _score_rows(context.broadcast(v), model.trie_file, parts, word_parts, model.rest is not None)
    asked = docs.select("doc_id", "text").mapInArrow(run, _ROWS)
    counted = model.counts.select(F.xxhash64("word").alias("name"), "n").mapInArrow(
        _pack_words(parts.number, word_parts), "part int, blob binary"
    )
    tables = counted.select(F.lit(WORDS).alias("kind"), "part", "blob")
    facts = None
    if model.rest is not None:
        tables = tables.unionByName(model.rest)
        trie = Trie.open(SparkFiles.get(model.trie_file))
        facts = context.broadcast((v.context_counts, np.array(trie.unigram), np.array(trie.unigram_weight)))
    tables = tables.withColumn("batch", F.lit(None).cast("long"))
    found = asked.unionByName(tables).groupBy("part").applyInArrow(_look_up(facts, model.least), "kind int, batch long, blob binary")
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return found.groupBy("batch").applyInArrow(_put_together(v.total), schema)
