"""Queries of the operators, their SQL where SQL can say it, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.llm import bpe, exact, hardneg, langid, lines, near, ngrams, packing, passages, periodic, topk, toxicity, urlfilter
from cartwise.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the ids form the immutable snapshot, the other half arrives as a batch."""
    return exact.dedup(table(spark, sf_dir, "documents"), fold("doc_id", 2) == 0)


SQL["op2_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
k AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k
"""


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows outside the held-out third, predicts all."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(fold("doc_id", 3) != 1))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled rows outside the held-out third, scores all."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(
        docs.filter(fold("doc_id", 3) != 1).select("doc_id", "text").join(
            table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id"
        )
    )
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth id asks, all rows answer."""
    found = topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


SQL["op7_exact_topk"] = """
WITH fine AS (
  SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND list_aggregate([x IS NOT NULL AND isfinite(x) FOR x IN embedding], 'bool_and')),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of at least 80 % of the united two-word shingles."""
    return near.components_of(table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.decide(table(spark, sf_dir, "documents"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has already."""
    return passages.find(table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` on all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op6_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from nine tenths of the texts, scores all."""
    docs = table(spark, sf_dir, "documents")
    model = ngrams.train(docs.filter(fold("doc_id", 10) != 0))
    found = ngrams.score(docs, model)
    return found.withColumn("held_out", fold("doc_id", 10) == 0)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all texts, a tenth of which are given one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted().alias("text"))
    found = periodic.find(docs).withColumn("best", periodic.longest("runs"))
    lines_of = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines_of, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# A run's stretch of equal words is at least six places long, so pairs of equal six-word pieces show it.
SQL["op13_periodic_runs"] = r"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS rk, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0,
         xor(4294967295, list_reduce(
           [4294967295::BIGINT] || [ascii(s)::BIGINT FOR s IN string_split(CAST(doc_id AS VARCHAR), '')],
           lambda c, b: list_reduce([xor(c, b)] || range(8),
             lambda r, k: xor(r // 2, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS h
  FROM documents),
u AS (SELECT *, len(w0) AS n, h // 10 AS g FROM t),
v AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM u),
d AS MATERIALIZED (
  SELECT rk, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN [w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] FOR i IN range(n)]
    ELSE w0 END AS w
  FROM v),
grams AS MATERIALIZED (
  SELECT rk, unnest(range(n - 5)) AS i, unnest([array_to_string(w[k + 1:k + 6], ' ') FOR k IN range(n - 5)]) AS six
  FROM d WHERE n >= 12),
pairs AS (
  SELECT a.rk, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.rk = b.rk AND a.six = b.six AND b.i > a.i),
places AS (SELECT rk, q, i, i - row_number() OVER (PARTITION BY rk, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT rk, q, min(i) AS s, count(*) + 5 AS m FROM places GROUP BY rk, q, island),
runs AS MATERIALIZED (
  SELECT rk, s, m + q AS length, min(q) AS q FROM stretches WHERE m >= greatest(12 - q, q) GROUP BY rk, s, m + q),
words AS (SELECT rk, unnest(range(n)) AS i, unnest(w) AS word FROM d),
gone AS (SELECT DISTINCT rk, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (
  SELECT rk, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (rk, i) GROUP BY rk),
best AS (
  SELECT rk, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
         first({'s': s, 'l': length, 'q': q} ORDER BY length DESC, s, q) AS r
  FROM runs GROUP BY rk)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r.s AS start, r.l AS length, r.q AS period,
       1000 * r.l // r.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(coalesce(body, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (rk) LEFT JOIN kept USING (rk)
"""


#: The rules of the query, as text: verdict, host and path.
URL_RULES = """
allow org/
block example.org/es/
block example.org/en/1
allow com/fr/
block com/de/
"""


def url_rules() -> list[urlfilter.Rule]:
    """``URL_RULES`` as rules; the path begins at the first slash."""
    out = []
    for line in URL_RULES.split("\n"):
        if line:
            verdict, key = line.split(" ")
            host, slash, path = key.partition("/")
            out.append(urlfilter.Rule(verdict, host, slash + path))
    return out


@query
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule that fits each url; urls without a rule are allowed."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), url_rules())


SQL["op12_url_filters"] = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (
  SELECT row_number() OVER () AS rk, page_id,
         CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS r
  FROM pages),
p AS (
  SELECT rk, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fit AS (
  SELECT rk, first(rules.host || rules.path ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC) AS rule,
         first(verdict ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC) AS verdict
  FROM p JOIN rules ON ('.' || p.host).ends_with('.' || rules.host) AND p.path.starts_with(rules.path)
  GROUP BY rk)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (rk)
"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth id is an anchor; every seventh row's label is moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL["op11_hard_negatives"] = """
WITH fine AS MATERIALIZED (
  SELECT row_number() OVER () AS rk, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_aggregate([x IS NOT NULL AND isfinite(x) FOR x IN embedding], 'bool_and'), true)),
s AS MATERIALIZED (
  SELECT a.rk, a.vec_id AS anchor_id, a.label = c.label AS same, c.rk AS other, c.vec_id,
         coalesce(CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT), 0) AS score
  FROM fine a JOIN fine c ON a.vec_id % 100 = 0 AND a.rk <> c.rk AND len(a.v) = len(c.v)),
p AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY rk ORDER BY score DESC, vec_id NULLS LAST, other) AS n FROM s WHERE same)
  WHERE n <= 5),
w AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, c.vec_id AS negative_id, p.score AS positive_score, c.score AS negative_score,
         row_number() OVER (PARTITION BY p.rk, p.n ORDER BY c.score DESC, c.vec_id NULLS LAST) AS rank
  FROM p JOIN s c ON c.rk = p.rk AND NOT c.same
    AND 30 * p.score <= 100 * c.score AND 100 * c.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM w WHERE rank <= 10
"""
