"""Block and allow lists for urls, kept as cascades of Bloom filters.

A rule is a verdict, a host and a path. It fits a url whose host is the rule's or a subdomain of it and
whose path starts with the rule's; the longest rule that fits decides (of equally long ones that with
the longer host). Urls that no rule fits get the verdict ``default``.

**Keys.** The only strings a list can ever be asked for are the ends of a url's host joined with the
starts of its path. Of these, a rule can only equal those of its own *shape* (number of host labels,
length of path), so a url has at most one key per shape that occurs among the rules. The keys of all urls
together are the corpus's complete key universe.

**Cascade.** Level 1 is a Bloom filter of the listed keys. Level 2 encodes those keys of the universe
that pass level 1 without being listed, level 3 the listed keys that pass level 2, and so on until
no false positive is left. A key of the universe is listed exactly if the first level it fails is an
even one, or if it passes all levels and their number is odd. So answers are exact, and no url is ever
joined with a list. One cascade tells listed keys from all others, a second one, asked for listed
keys only, tells blocked from allowed ones.

Everything is DataFrame functions: bits are set by ``bit_or`` per word and read by ``getbit``. The
false positive rate of level 1 follows the size of the universe, found by a sketch, so that about as many
keys reach level 2 as are listed; later levels halve them. A cascade thus has a few dozen bits per rule and
grows with the logarithm of the corpus only. Rules are given as a Python sequence, and levels travel
to the tasks inside the plan like the rules would; a level of more than ``MOST_WORDS`` words (16 MB) is an
error that names the remedy (another seed or fewer rules), never a wrong answer. The corpus is read
three times (count, false positives, verdicts), urls only, and nothing of it is shuffled but counts,
one sketch and the keys that pass level 1.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there
up to ``?``, ``#`` or the end, as it is. Defined cases: a null url or one without ``://`` has an empty host and
path and gets the default. Repeated rows and null ids each get their row; other columns are ignored.
Without rules all urls get the default.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.session import materialize

ALLOW, BLOCK = "allow", "block"
#: Share of keys passing a level above the first.
LATER_RATE = 0.5
#: 64-bit words of one level.
MOST_WORDS = 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    def __post_init__(self):
        if self.verdict not in (ALLOW, BLOCK):
            raise ValueError(f"a verdict is {ALLOW} or {BLOCK}, not {self.verdict!r}")
        if not self.host or any(c in self.host for c in "/?#"):
            raise ValueError(f"not a host: {self.host!r}")
        if (self.path and not self.path.startswith("/")) or any(c in self.path for c in "?#"):
            raise ValueError(f"not a path: {self.path!r}")

    @property
    def key(self) -> str:
        return self.host.translate(str.maketrans(UPPER, LOWER)) + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return self.host.count(".") + 1, len(self.path)


@dataclass(frozen=True)
class Level:
    """``bits`` places, of which each key sets ``hashes``."""

    seed: int
    bits: int
    hashes: int
    words: dict[int, int]

    @staticmethod
    def sized(keys: int, rate: float, seed: int) -> tuple[int, int]:
        hashes = max(1, round(-math.log2(rate)))
        return max(64, -(-int(keys * hashes / math.log(2)) // 64) * 64), hashes

    def passes(self, key: Column) -> Column:
        """Whether all places of ``key`` are set."""
        text = ",".join(str(self.words.get(i, 0)) for i in range(self.bits // 64))
        words = F.split(F.lit(text), ",").cast("array<bigint>")
        first, step = _hashes(key, self.seed)
        out = F.lit(True)
        for i in range(self.hashes):
            at = _place(first, step, i, self.bits)
            out = out & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return out


def _hashes(key: Column, seed: int) -> tuple[Column, Column]:
    """Two 31-bit hashes, so that no sum of their multiples overflows.

    The seed comes first: keys whose hashes are alike at one level then differ at the next.
    """
    both = F.xxhash64(F.lit(seed), key)
    return F.shiftrightunsigned(both, 33), F.pmod(both, F.lit(1 << 31))


def _place(first: Column, step: Column, i: int, bits: int) -> Column:
    return F.pmod(first + step * i, F.lit(bits).cast("long"))


def build_level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A level of all ``keys`` (key, ...), of which there are ``count``."""
    bits, hashes = Level.sized(count, rate, seed)
    if bits // 64 > MOST_WORDS:
        raise ValueError(f"a level of {count} keys takes {bits // 64} words, more than {MOST_WORDS}; split the rules")
    first, step = _hashes(F.col("key"), seed)
    at = F.explode(F.array(*[_place(first, step, i, bits) for i in range(hashes)])).alias("at")
    mask = F.expr("shiftleft(1L, CAST(at % 64 AS INT))")
    words = keys.select(at).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(mask).alias("mask"))
    return Level(seed, bits, hashes, {r["word"]: r["mask"] for r in words.collect()})  # at most MOST_WORDS rows


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether ``key``, which must be of the universe, is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float | None = None) -> Cascade:
    """Cascade of the distinct keys ``listed`` (key) within ``universe`` (key, repeats allowed).

    ``listed`` is small (see the module); the universe is scanned twice and not shuffled.
    """
    n = listed.count()
    if n == 0:
        return Cascade(())
    if rate is None:
        others = universe.agg(F.approx_count_distinct("key")).first()[0] or 0
        rate = min(LATER_RATE, n * math.sqrt(0.5) / max(others, n))
    levels = [build_level(listed, n, rate, 0)]
    # Of the universe, only what passes level 1 is grouped; the list itself tells what is listed.
    passing = universe.filter(levels[0].passes(F.col("key"))).select("key", F.lit(0).alias("is_listed"))
    marked = passing.unionByName(listed.select("key", F.lit(1).alias("is_listed")))
    known = materialize(marked.groupBy("key").agg(F.max("is_listed").alias("is_listed")), "passing")
    members, strangers = known.filter("is_listed = 1").select("key"), known.filter("is_listed = 0").select("key")
    inside, outside = members, strangers
    while (left := outside.count()) > 0:
        seed = len(levels)
        levels.append(build_level(outside, left, LATER_RATE, seed))
        # What was encoded two levels ago and passes the new level has to be told apart by the next one.
        inside, outside = outside, materialize(inside.filter(levels[-1].passes(F.col("key"))), "passing")
    return Cascade(tuple(levels))


def parts(url: str | Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    u = F.col(url) if isinstance(url, str) else url
    rest = F.coalesce(F.get(F.split(u, "://", 2), F.lit(1)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The url's keys, one (length, host_length, key) per shape it is long enough for."""
    labels = F.length(host) - F.length(F.translate(host, ".", "")) + 1

    def one(count: int, length: int) -> Column:
        end = F.substring_index(host, ".", -count)
        key = F.concat(end, F.substring(path, 1, length) if length else F.lit(""))
        found = F.struct(F.length(key).alias("length"), F.length(end).alias("host_length"), key.alias("key"))
        return F.when((labels >= count) & (F.length(path) >= length) & (host != ""), found)

    return F.filter(F.array(*[one(c, n) for c, n in shapes]), lambda k: k.isNotNull())


def judge(
    pages: DataFrame, rules: Sequence[Rule], default: str = ALLOW, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; ``rule`` is null where none fits."""
    verdicts: dict[str, str] = {}
    for r in rules:
        if verdicts.setdefault(r.key, r.verdict) != r.verdict:
            raise ValueError(f"{r.key} is both allowed and blocked")
    host, path = parts(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not verdicts:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shapes = sorted({r.shape for r in rules})
    keyed = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), shapes))
    listing = json.dumps([{"key": k, "verdict": v} for k, v in verdicts.items()])
    parsed = F.from_json(F.lit(listing), "array<struct<key: string, verdict: string>>")
    lists = pages.sparkSession.range(1).select(F.inline(parsed))
    universe = keyed.select(F.explode("keys.key").alias("key"))
    listed = build_cascade(lists.select("key"), universe)
    blocked = build_cascade(lists.filter(F.col("verdict") == BLOCK).select("key"), lists.select("key"))
    best = F.array_max(F.filter("keys", lambda k: listed.contains(k["key"])))["key"]
    verdict = F.when(F.col("rule").isNull(), default).when(blocked.contains(F.col("rule")), BLOCK).otherwise(ALLOW)
    return keyed.withColumn("rule", best).select("page_id", "host", "path", "rule", verdict.alias("verdict"))
