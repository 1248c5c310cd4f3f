"""History arrays, names and sequence losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise.functions.columns import decode_nested, encode_nested
from cartwise.plans import histories, metrics, text
from cartwise.registry import query
from cartwise.session import scratch_path
from cartwise.sources import files
from cartwise.sources.baskets import load

# Baskets with lines, numbered per user; a history is all of them but the newest.
STEPS = """
    b AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_number) AS step,
            count(*) OVER (PARTITION BY user_id) AS steps, (row_number() OVER (PARTITION BY user_id ORDER BY order_number) - 1) // 1000 AS chunk
        FROM (SELECT user_id, order_id, order_number, list(l.product_id ORDER BY add_to_cart_order) AS products,
                list(aisle_id ORDER BY add_to_cart_order) AS aisles, list(department_id ORDER BY add_to_cart_order) AS departments,
                list(reordered ORDER BY add_to_cart_order) AS reorders, count(*) AS order_size, sum(reordered)::BIGINT AS reorder_size,
                max(order_dow) AS dow, max(order_hour_of_day) AS hour, coalesce(max(days_since_prior_order), 0) AS days
              FROM c_lines l JOIN c_products p ON p.product_id = l.product_id GROUP BY user_id, order_id, order_number))"""


@query(
    "user_sequences",
    "user_id,chunk:i order_ids,order_numbers:a product_ids,aisle_ids,department_ids,reorders:s",
    f"""{STEPS};;SELECT user_id, chunk, list(order_id ORDER BY step) AS order_ids, list(order_number ORDER BY step) AS order_numbers,
        string_agg(array_to_string(products, '_'), ' ' ORDER BY step) AS product_ids,
        string_agg(array_to_string(aisles, '_'), ' ' ORDER BY step) AS aisle_ids,
        string_agg(array_to_string(departments, '_'), ' ' ORDER BY step) AS department_ids,
        string_agg(array_to_string(reorders, '_'), ' ' ORDER BY step) AS reorders FROM b GROUP BY user_id, chunk""",
)
def user_sequences(spark, sf):
    nested = histories.user_sequences(load(spark, sf))
    return nested.select(
        "user_id",
        "chunk",
        F.col("orders.order_id").alias("order_ids"),
        F.col("orders.order_number").alias("order_numbers"),
        encode_nested(F.col("orders.products")).alias("product_ids"),
        encode_nested(F.col("orders.aisles")).alias("aisle_ids"),
        encode_nested(F.col("orders.departments")).alias("department_ids"),
        encode_nested(F.col("orders.reorders")).alias("reorders"),
    )


@query(
    "sequence_codec",
    "user_id,chunk,orders,products:i encoded:s",
    f"""{STEPS};;SELECT user_id, chunk, count(*) AS orders, sum(order_size) AS products,
        string_agg(array_to_string(products, '_'), ' ' ORDER BY step) AS encoded FROM b GROUP BY user_id, chunk""",
)
def sequence_codec(spark, sf):
    """Product ids to text and back: sizes are taken from the decoded arrays."""
    encoded = histories.user_sequences(load(spark, sf)).select(
        "user_id", "chunk", encode_nested(F.col("orders.products")).alias("encoded")
    )
    decoded = encoded.withColumn("decoded", decode_nested(F.col("encoded")))
    return decoded.select(
        "user_id",
        "chunk",
        F.size("decoded").alias("orders"),
        F.size(F.flatten("decoded")).alias("products"),
        encode_nested(F.col("decoded")).alias("encoded"),
    )


@query(
    "user_entity_sets",
    "user_id:i products,departments:a",
    f"""{STEPS};;SELECT user_id, list_sort(list_distinct(flatten(list(products)))) AS products,
        list_sort(list_distinct(flatten(list(departments)))) AS departments FROM b WHERE step < steps GROUP BY user_id""",
)
def user_entity_sets(spark, sf):
    """Distinct products and departments of every history; bounded by the catalogue."""
    rows = histories.basket_rows(load(spark, sf)).filter("step < steps")
    items = rows.select("user_id", F.explode("items").alias("i"))
    return items.groupBy("user_id").agg(
        F.array_sort(F.collect_set("i.product_id")).alias("products"),
        F.array_sort(F.collect_set("i.department_id")).alias("departments"),
    )


HISTORY_SPEC = (
    "user_id,product_id,chunk,aisle_id,department_id:i product_name:s is_ordered_history,index_in_order_history,"
    "order_size_history,reorder_size_history,order_number_history,order_dow_history,order_hour_history,"
    "days_since_prior_order_history:a label:i"
)
# Histories per user, and the same with the pseudo-product added.
PRODUCT_HISTORY = """
    h AS MATERIALIZED (
        SELECT user_id, chunk, coalesce(list(products ORDER BY step) FILTER (step < steps), []) AS past,
            coalesce(list(order_size ORDER BY step) FILTER (step < steps), []) AS sizes,
            coalesce(list(reorder_size ORDER BY step) FILTER (step < steps), []) AS again, list(order_number ORDER BY step) AS numbers,
            list(dow ORDER BY step) AS order_dow_history, list(hour ORDER BY step) AS order_hour_history,
            list(days ORDER BY step) AS days_since_prior_order_history
        FROM b GROUP BY user_id, chunk),
    nx AS MATERIALIZED (SELECT user_id, products, reorder_size FROM b WHERE step = steps),
    hp AS MATERIALIZED (
        SELECT h.user_id, s.product_id, h.chunk, c.aisle_id, c.department_id, c.product_name,
            [CASE WHEN list_contains(o, s.product_id) THEN 1 ELSE 0 END for o in h.past] AS is_ordered_history,
            [coalesce(list_position(o, s.product_id), 0) for o in h.past] AS index_in_order_history,
            h.sizes AS order_size_history, h.again AS reorder_size_history, h.numbers AS order_number_history,
            h.order_dow_history, h.order_hour_history, h.days_since_prior_order_history,
            CASE WHEN list_contains(nx.products, s.product_id) THEN 1 ELSE 0 END AS label
        FROM (SELECT DISTINCT user_id, unnest(products) AS product_id FROM b WHERE step < steps) s
        JOIN h ON h.user_id = s.user_id JOIN nx ON nx.user_id = s.user_id JOIN c_products c ON c.product_id = s.product_id),
    hn AS MATERIALIZED (
        SELECT h.user_id, 0 AS product_id, h.chunk, 0 AS aisle_id, 0 AS department_id, '0' AS product_name,
            [CASE WHEN r = 0 THEN 1 ELSE 0 END for r in h.again] AS is_ordered_history, [0 for r in h.again] AS index_in_order_history,
            h.sizes AS order_size_history, h.again AS reorder_size_history, h.numbers AS order_number_history,
            h.order_dow_history, h.order_hour_history, h.days_since_prior_order_history,
            CASE WHEN nx.reorder_size = 0 THEN 1 ELSE 0 END AS label
        FROM h JOIN nx ON nx.user_id = h.user_id WHERE len(h.numbers) > 1)"""


@query("seq_history_product", HISTORY_SPEC, f"{STEPS},{PRODUCT_HISTORY};;SELECT * FROM hp")
def seq_history_product(spark, sf):
    return histories.history_product(load(spark, sf))


@query("seq_history_none", HISTORY_SPEC, f"{STEPS},{PRODUCT_HISTORY};;SELECT * FROM hn")
def seq_history_none(spark, sf):
    return histories.history_none(load(spark, sf))


@query(
    "seq_history_department",
    "user_id,department_id,chunk:i is_ordered_history,num_products_from_department_history,order_size_history,order_number_history:a",
    f"""{STEPS};;SELECT h.user_id, s.department_id, h.chunk,
        [CASE WHEN list_contains(o, s.department_id) THEN 1 ELSE 0 END for o in h.past] AS is_ordered_history,
        [len([x for x in o if x = s.department_id]) for o in h.past] AS num_products_from_department_history,
        [len(list_distinct(o)) for o in h.past] AS order_size_history, h.numbers AS order_number_history
    FROM (SELECT DISTINCT user_id, unnest(departments) AS department_id FROM b WHERE step < steps) s
    JOIN (SELECT user_id, chunk, coalesce(list(departments ORDER BY step) FILTER (step < steps), []) AS past,
            list(order_number ORDER BY step) AS numbers FROM b GROUP BY user_id, chunk) h ON h.user_id = s.user_id""",
)
def seq_history_department(spark, sf):
    return histories.history_department(load(spark, sf))


# Vocabulary of product names (rare words share 0) and the encoded names of one table.
VOCABULARY = """
    tok AS MATERIALIZED (
        SELECT p_partkey, pos, words[pos] AS word
        FROM (SELECT p_partkey, words, unnest(range(1, len(words) + 1)) AS pos
              FROM (SELECT p_partkey, string_split_regex(trim(lower(p_name)), '\\s+') AS words FROM part))),
    counted AS (SELECT word, count(*) AS word_count FROM tok WHERE word <> '' GROUP BY word),
    vocab AS MATERIALIZED (
        SELECT *, row_number() OVER (ORDER BY word_count DESC, word) AS word_id FROM counted WHERE word_count >= 10
        UNION ALL SELECT *, 0 FROM counted WHERE word_count < 10)"""


def _names(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select("p_partkey", F.col("p_name").alias("product_name"))


def _vocabulary(spark, sf):
    return text.vocabulary(_names(spark, sf), "p_partkey")


@query("name_vocabulary", "word:s word_count,word_id:i", f"{VOCABULARY};;SELECT * FROM vocab")
def name_vocabulary(spark, sf):
    return _vocabulary(spark, sf)


ENCODED = """SELECT t.p_partkey, list(coalesce(v.word_id, 0) ORDER BY t.pos) AS name_ids
    FROM tok t LEFT JOIN vocab v ON v.word = t.word GROUP BY t.p_partkey"""


@query("encode_names", "p_partkey:i name_ids:a", f"{VOCABULARY};;{ENCODED}")
def encode_names(spark, sf):
    return text.encode(_names(spark, sf), "p_partkey", _vocabulary(spark, sf))


@query(
    "name_multi_hot",
    "p_partkey:i word_ids:a",
    f"{VOCABULARY};;SELECT p_partkey, list_sort(list_distinct(name_ids)) AS word_ids FROM ({ENCODED})",
)
def name_multi_hot(spark, sf):
    return text.multi_hot(text.encode(_names(spark, sf), "p_partkey", _vocabulary(spark, sf)), "p_partkey")


@query(
    "document_vocabulary",
    "word:s word_count,word_id:i",
    """tok AS (SELECT unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents),
       counted AS (SELECT word, count(*) AS word_count FROM tok WHERE word <> '' GROUP BY word);;
       SELECT *, row_number() OVER (ORDER BY word_count DESC, word) AS word_id FROM counted WHERE word_count >= 10
       UNION ALL SELECT *, 0 FROM counted WHERE word_count < 10""",
)
def document_vocabulary(spark, sf):
    """The same vocabulary over whole documents."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    return text.vocabulary(documents.select("doc_id", F.col("text").alias("product_name")), "doc_id")


PADDED = f"""{VOCABULARY},
    names AS MATERIALIZED (SELECT c.product_id, list(coalesce(v.word_id, 0) ORDER BY u.pos) AS ids
        FROM c_products c, LATERAL (SELECT w.words[i.pos] AS word, i.pos FROM (SELECT string_split_regex(trim(lower(c.product_name)), '\\s+') AS words) w,
            LATERAL (SELECT unnest(range(1, len(w.words) + 1)) AS pos) i) u
        LEFT JOIN vocab v ON v.word = u.word GROUP BY c.product_id),
    x AS MATERIALIZED (
        SELECT u.user_id, u.product_id, u.aisle_id, u.department_id, u.label,
            list_resize(is_ordered_history[1:100], 100, 0) AS is_ordered_history,
            list_resize(index_in_order_history[1:100], 100, 0) AS index_in_order_history,
            list_resize(order_size_history[1:100], 100, 0) AS order_size_history,
            list_resize(reorder_size_history[1:100], 100, 0) AS reorder_size_history,
            list_resize(order_number_history[1:100], 100, 0) AS order_number_history,
            list_resize(order_dow_history[1:100], 100, 0) AS order_dow_history,
            list_resize(order_hour_history[1:100], 100, 0) AS order_hour_history,
            list_resize(days_since_prior_order_history[1:100], 100, 0) AS days_since_prior_order_history,
            least(len(is_ordered_history), 100) AS history_length,
            list_resize(coalesce(n.ids, [0])[1:30], 30, 0) AS product_name, least(len(coalesce(n.ids, [0])), 30) AS product_name_length
        FROM (SELECT * FROM hp UNION ALL SELECT * FROM hn) u LEFT JOIN names n ON n.product_id = u.product_id)"""
PADDED_SQL = f"{STEPS},{PRODUCT_HISTORY},{PADDED};;"
PADDED_SPEC = (
    "user_id,product_id,aisle_id,department_id,label,history_length,product_name_length:i "
    + ",".join(f"{name}_history" for name in (*histories.HISTORIES, *histories.ORDER_HISTORIES))
    + ",product_name:a"
)


def _padded(spark, sf):
    b = load(spark, sf)
    names = text.encode(b.products.select("product_id", "product_name"), "product_id", _vocabulary(spark, sf))
    return histories.padded(b, names)


@query("seq_padded", PADDED_SPEC, f"{PADDED_SQL}SELECT * FROM x")
def seq_padded(spark, sf):
    return _padded(spark, sf)


@query("seq_matrix_store", PADDED_SPEC, f"{PADDED_SQL}SELECT * FROM x")
def seq_matrix_store(spark, sf):
    """Padded examples stored as columns of arrays and read back."""
    return files.roundtrip(_padded(spark, sf), scratch_path(spark, "examples"))


SHIFTED = """SELECT user_id, product_id, is_ordered_history[2:100] || is_ordered_history[1:1] AS next_is_ordered,
    order_number_history[2:100] || order_number_history[1:1] AS order_number_history,
    CASE WHEN product_id = 0 THEN 1 ELSE 0 END AS is_none, history_length - 1 AS history_length FROM x"""


@query(
    "seq_shift_targets",
    "user_id,product_id,is_none,history_length:i next_is_ordered,order_number_history:a",
    PADDED_SQL + SHIFTED,
)
def seq_shift_targets(spark, sf):
    return histories.shift_targets(_padded(spark, sf))


# One row per real step of each padded example.
STEP_ROWS = (
    "(SELECT user_id, product_id, unnest(range(1, history_length + 1)) AS pos, "
    + ", ".join(f"unnest({n}_history[1:history_length]) AS {n}" for n in histories.DEPTHS)
    + " FROM x)"
)


@query(
    "seq_scaled_features",
    "user_id,product_id,pos:i " + ",".join(f"{name}_scaled" for name in histories.SCALES) + ":d",
    f"{PADDED_SQL}SELECT user_id, product_id, pos, "
    + ", ".join(f"{n} / {d}::DOUBLE AS {n}_scaled" for n, d in histories.SCALES.items())
    + f" FROM {STEP_ROWS}",
)
def seq_scaled_features(spark, sf):
    """All scaled histories, step by step."""
    return histories.scaled(_padded(spark, sf))


def _hot_sql() -> str:
    """The text of a sparse vector: its width, the places of its ones, and the ones."""
    places, base = [], 0
    for name, depth in histories.DEPTHS.items():
        places.append(f"CASE WHEN {name} >= 0 AND {name} < {depth} THEN {base} + {name} END")
        base += depth
    return (
        f"SELECT user_id, product_id, pos, '({base},[' || array_to_string(cells, ',') || '],[' "
        f"|| array_to_string([1.0 FOR c IN cells], ',') || '])' AS hot FROM (SELECT user_id, product_id, pos, "
        f"[c FOR c IN [{', '.join(places)}] IF c IS NOT NULL] AS cells FROM {STEP_ROWS})"
    )


@query("seq_one_hot", "user_id,product_id,pos:i hot:s", PADDED_SQL + _hot_sql())
def seq_one_hot(spark, sf):
    """The one-hot vector of every step of every example."""
    return histories.one_hot(_padded(spark, sf))


@query(
    "seq_last_state",
    "user_id,product_id," + ",".join(f"last_{name}" for name in histories.HISTORIES) + ":i",
    PADDED_SQL
    + "SELECT user_id, product_id, "
    + ", ".join(f"{n}_history[history_length] AS last_{n}" for n in histories.HISTORIES)
    + " FROM x",
)
def seq_last_state(spark, sf):
    return histories.last_state(_padded(spark, sf))


def _guessed(spark, sf):
    """Next-step truth with a repeatable guess: what was bought now is likely bought next."""
    guess = F.transform("is_ordered_history", lambda v: F.lit(0.1) + F.lit(0.8) * v)
    return histories.shift_targets(_padded(spark, sf).withColumn("guess", guess), keep=["guess"])


STEPWISE = f"""SELECT y, 0.1::DOUBLE + 0.8::DOUBLE * v AS p FROM (
    SELECT unnest(is_ordered_history[2:history_length]) AS y, unnest(is_ordered_history[1:history_length - 1]) AS v
    FROM x WHERE history_length > 1)"""


@query(
    "sequence_log_loss",
    "sequence_log_loss:d",
    f"{PADDED_SQL}SELECT avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS sequence_log_loss FROM ({STEPWISE})",
)
def sequence_log_loss(spark, sf):
    return metrics.sequence_log_loss(_guessed(spark, sf), "next_is_ordered", "guess", "history_length")


@query(
    "sequence_rmse",
    "sequence_rmse:d",
    f"{PADDED_SQL}SELECT sqrt(avg((y - p) * (y - p))) AS sequence_rmse FROM ({STEPWISE})",
)
def sequence_rmse(spark, sf):
    return metrics.sequence_rmse(_guessed(spark, sf), "next_is_ordered", "guess", "history_length")
