"""The basket model: products, orders and order lines, however they are stored.

``Baskets`` holds three frames that all plans share:

* ``products``: product_id, product_name, aisle_id, department_id, aisle, department;
* ``orders``: one row per order with its place in the user's history;
* ``lines``: one row per (order, product) with the order's attributes.

``load`` derives them from a retail star schema (``orders``, ``lineitem``, ``part``), a product
being a (brand, type) pair, an aisle a brand and a department a type. Orders and lines are written
once per session to the shared folder when first asked for: numbering histories, folding repeats
and flagging reorders move every line three times, and each mart would otherwise do that again.
Later reads are pruned and filtered like those of any Parquet table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwise.operators.joins import lookup_join
from cartwise.operators.scan import BLOCK_IDS, GROUP_ROWS, dense_ids, ordered_scan, position_block
from cartwise.session import materialize, materialize_bucketed, open_bucketed
from cartwise.sources import files

PRIOR, TRAIN, TEST = "prior", "train", "test"
# Lines are stored in buckets of these keys: the grain every mart starts from, fine enough for busy users and products.
PAIR = ["user_id", "product_id"]
# Lines that one task sorts: partitions and buckets of lines grow in number with the lines, so that sorts stay in memory.
TASK_LINES = 500_000

# The columns every plan may read. ``order_id`` has the source's type; a source leaves NULL what it does not know.
PRODUCT_COLUMNS = {
    "product_id": "bigint",
    "product_name": "string",
    "aisle_id": "bigint",
    "department_id": "bigint",
    "aisle": "string",
    "department": "string",
}
ORDER_COLUMNS = {
    "order_id": None,
    "user_id": "bigint",
    "order_date": "date",
    "order_number": "bigint",
    "user_total_orders": "bigint",
    "rank_order": "bigint",
    "eval_set": "string",
    "days_since_prior_order": "int",
    "timeline": "bigint",
    "order_dow": "int",
    "order_hour_of_day": "bigint",
}
LINE_COLUMNS = ORDER_COLUMNS | {
    "product_id": "bigint",
    "units": "double",
    "dollars": "double",
    "add_to_cart_order": "int",
    "order_size": "bigint",
    "reordered": "int",
    "pair_nth": "bigint",
    "pair_lines": "bigint",
    "pair_prior_lines": "bigint",
    "gap": "bigint",
}
# What no source may lack.
REQUIRED = {"order_id", "user_id", "order_number", "eval_set", "product_id", "add_to_cart_order", "reordered", "timeline"}


def conform(df: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """``df`` with exactly ``columns`` of the declared types; what it lacks is NULL."""
    lacking = [c for c in columns if c in REQUIRED and c not in df.columns]
    if lacking:
        raise ValueError(f"baskets need {', '.join(lacking)}")

    def typed(name: str, kind: str | None) -> Column:
        c = F.col(name) if name in df.columns else F.lit(None)
        return (c if kind is None else c.cast(kind)).alias(name)

    return df.select(*[typed(name, kind) for name, kind in columns.items()])


def _check(what: str, df: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """Refuse a frame that does not keep the contract; whole numbers may be of either width."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    whole = {"int", "bigint"}
    for name, kind in columns.items():
        if name not in kinds:
            raise ValueError(f"{what} lack {name}; see conform()")
        if kind is not None and kinds[name] != kind and not {kinds[name], kind} <= whole:
            raise TypeError(f"{name} of the {what} is {kinds[name]}, not {kind}; see conform()")
    return df


class Baskets:
    """Frames that keep the contract above, which is checked here.

    ``longest`` is the order count of the busiest user; plans cut histories by it. ``test_lines`` tells whether
    the lines of orders to be scored are there: without them their labels are NULL.
    """

    def __init__(
        self,
        products: DataFrame,
        orders: DataFrame | None,
        lines: DataFrame | None,
        longest: int,
        test_lines: bool = True,
    ):
        self.test_lines = test_lines
        self.products = _check("products", products, PRODUCT_COLUMNS)
        self.longest = longest
        if orders is not None:
            self.orders = _check("orders", orders, ORDER_COLUMNS)
        if lines is not None:
            self.lines = _check("lines", lines, LINE_COLUMNS)

    @property
    def split(self) -> bool:
        """True where one user may have more orders than a single task should hold."""
        return self.longest > GROUP_ROWS

    @property
    def prior_orders(self) -> DataFrame:
        return self.orders.filter(F.col("eval_set") == PRIOR)

    @property
    def target_orders(self) -> DataFrame:
        return self.orders.filter(F.col("eval_set") != PRIOR)

    @property
    def labelled_targets(self) -> DataFrame:
        """Target orders with ``labelled``: whether the source knows what was bought in them."""
        return self.target_orders.withColumn("labelled", F.lit(self.test_lines) | (F.col("eval_set") != TEST))

    @property
    def prior(self) -> DataFrame:
        return self.lines.filter(F.col("eval_set") == PRIOR)

    @property
    def target(self) -> DataFrame:
        return self.lines.filter(F.col("eval_set") != PRIOR)


def number_orders(raw: DataFrame, split: bool = False) -> DataFrame:
    """Place every order in its user's history.

    ``raw`` has order_id, user_id, order_date. A user's orders are cut by day (and id range
    within the day) where ``split`` is set, so no task holds a whole long history.
    """
    placed = ordered_scan(
        raw,
        ["user_id"],
        ["order_date", "order_id"],
        [F.col("order_date"), F.floor(F.col("order_id") / BLOCK_IDS)],
        running={"order_number": F.lit(1)},
        previous={"prior_date": F.col("order_date")},
        whole={"user_total_orders": ("sum", F.lit(1)), "first_date": ("min", F.col("order_date"))},
        split=split,
    )
    last = F.col("order_number") == F.col("user_total_orders")
    return placed.select(
        "order_id",
        "user_id",
        "order_date",
        "order_number",
        "user_total_orders",
        (F.col("user_total_orders") - F.col("order_number") + 1).alias("rank_order"),
        F.when(~last, PRIOR)
        .when(F.pmod("user_id", F.lit(3)) == 0, TEST)
        .otherwise(TRAIN)
        .alias("eval_set"),
        F.date_diff("order_date", "prior_date").alias("days_since_prior_order"),
        # The gaps of a calendar-dated history add up to the distance from its first day.
        F.date_diff("order_date", "first_date").alias("timeline"),
        (F.dayofweek("order_date") - 1).alias("order_dow"),
        F.pmod("order_id", F.lit(24)).alias("order_hour_of_day"),
    )


def catalogue(part: DataFrame) -> DataFrame:
    """Distinct (brand, type) pairs with product, aisle and department ids.

    Ids are dense ranks, found by range partitions.
    """
    pairs = part.groupBy("p_brand", "p_type").agg(F.min("p_name").alias("product_name"))
    pairs = materialize(pairs)
    numbered = pairs.join(dense_ids(pairs, ["p_brand", "p_type"], "product_id"), ["p_brand", "p_type"])
    numbered = lookup_join(numbered, dense_ids(pairs, ["p_brand"], "aisle_id"), "p_brand")
    numbered = lookup_join(numbered, dense_ids(pairs, ["p_type"], "department_id"), "p_type")
    ids = [F.col(c).cast("bigint").alias(c) for c in ("product_id", "aisle_id", "department_id")]
    named = [F.col("p_brand").alias("aisle"), F.col("p_type").alias("department")]
    return materialize(numbered.select(*ids, "product_name", *named))


def complete_orders(given: DataFrame, split: bool = False) -> DataFrame:
    """Orders that come with their number and set: add totals, newest-first rank and timeline."""
    scanned = ordered_scan(
        given,
        ["user_id"],
        ["order_number"],
        [position_block("order_number")],
        running={"timeline": F.coalesce(F.col("days_since_prior_order"), F.lit(0))},
        whole={"user_total_orders": ("sum", F.lit(1))},
        split=split,
    )
    return scanned.withColumn("rank_order", F.col("user_total_orders") - F.col("order_number") + 1)


def parts_of(spark: SparkSession, lines: int) -> int | None:
    """Partitions for so many lines, or None where the session's own number of them will do."""
    wanted = -(-lines // TASK_LINES)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return rows.repartition(*keys) if parts is None else rows.repartition(parts, *keys)


def order_lines(keyed: DataFrame, orders: DataFrame, split: bool = False, parts: int | None = None) -> DataFrame:
    """Lines per (order, product) with cart position, reorder flag and the order's attributes.

    ``keyed`` has order_id, product_id, line, units, dollars. It is dealt by order once: repeats are
    folded, carts numbered and sized, and orders joined where their lines lie.
    """
    folded = _dealt(keyed, parts, "order_id").groupBy("order_id", "product_id").agg(
        F.min("line").alias("line"), F.sum("units").alias("units"), F.sum("dollars").alias("dollars")
    )
    cart = Window.partitionBy("order_id").orderBy("line", "product_id")
    return place_lines(folded.withColumn("add_to_cart_order", F.row_number().over(cart)).drop("line"), orders, split, parts)


def place_lines(lines: DataFrame, orders: DataFrame, split: bool = False, parts: int | None = None) -> DataFrame:
    """Put (order, product) lines with a cart position into the histories of their users.

    ``reordered`` is worked out unless the lines bring it. The scan also leaves the line's place
    among the purchases of its pair (``pair_nth`` of ``pair_lines``, of which
    ``pair_prior_lines`` lie in the history) and the days since the purchase before (``gap``).
    Marts thus need no window over the lines, and rows of a pair lie together, so their
    aggregates combine before anything is shuffled. ``parts`` is the number of partitions of many lines.
    """
    sized = lines.withColumn("order_size", F.count("*").over(Window.partitionBy("order_id")))
    attributed = sized.join(orders, "order_id")
    scanned = ordered_scan(
        # Where histories are cut, the scan deals blocks of them, not whole ones.
        attributed if split or parts is None else _dealt(attributed, parts, *PAIR),
        ["user_id", "product_id"],
        ["order_number"],
        [position_block("order_number")],
        running={"pair_nth": F.lit(1)},
        previous={"__before": F.col("timeline")},
        whole={
            "pair_lines": ("sum", F.lit(1)),
            "pair_prior_lines": ("sum", (F.col("eval_set") == PRIOR).cast("int")),
        },
        split=split,
    )
    placed = scanned.withColumn("gap", F.col("timeline") - F.col("__before")).drop("__before")
    if "reordered" in lines.columns:
        return placed
    return placed.withColumn("reordered", (F.col("pair_nth") > 1).cast("int"))


def longest_history(raw: DataFrame) -> int:
    """Orders of the busiest user: decides once whether histories have to be cut."""
    per_user = raw.groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.agg(F.max("n")).first()[0] or 0


class StoredBaskets(Baskets):
    """Baskets derived from star-schema tables and kept in the shared folder."""

    def __init__(self, raw_orders: DataFrame, lineitem: DataFrame, part: DataFrame):
        super().__init__(catalogue(part), None, None, longest_history(raw_orders))
        self._raw, self._lineitem, self._part = raw_orders, lineitem, part

    @cached_property
    def orders(self) -> DataFrame:
        return materialize(number_orders(self._raw, self.split), "orders")

    @cached_property
    def lines(self) -> DataFrame:
        ids = self.products.select(
            F.col("aisle").alias("p_brand"), F.col("department").alias("p_type"), "product_id"
        )
        parts = lookup_join(self._part.select("p_partkey", "p_brand", "p_type"), ids, ["p_brand", "p_type"])
        keyed = lookup_join(
            self._lineitem.select(
                F.col("l_orderkey").alias("order_id"),
                F.col("l_partkey").alias("part_key"),
                F.col("l_linenumber").alias("line"),
                F.col("l_quantity").alias("units"),
                F.col("l_extendedprice").alias("dollars"),
            ),
            parts.select(F.col("p_partkey").alias("part_key"), "product_id"),
            "part_key",
        )
        parts = parts_of(keyed.sparkSession, self._lineitem.count())
        placed = order_lines(keyed.drop("part_key"), self.orders, self.split, parts)
        return materialize_bucketed(placed, "lines", PAIR, buckets=parts)


_LOADED: dict[tuple[str, str], StoredBaskets] = {}


def load(spark: SparkSession, sf_dir: str, refresh: bool = False) -> Baskets:
    """Basket frames over the tables of ``sf_dir``, shared by all queries of a session.

    ``refresh`` derives them anew after the tables have changed.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if refresh or key not in _LOADED:
        raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
        )
        lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        _LOADED[key] = StoredBaskets(raw, lineitem, spark.read.parquet(f"{sf_dir}/part.parquet"))
    return _LOADED[key]


def from_csv(spark: SparkSession, folder: str) -> Baskets:
    """Baskets from a folder of CSV tables that already describe histories.

    Reads ``orders``, ``order_products__prior``, ``order_products__train``, ``products``,
    ``aisles`` and ``departments`` (``.csv``, with header). Orders to be scored have no lines, so their
    candidates' labels are NULL. There are no dates: rolling windows over them are empty.
    """

    def table(name: str, schema: str) -> DataFrame:
        return files.read_csv(spark, f"{folder}/{name}.csv", schema)

    products = lookup_join(table("products", files.PRODUCTS), table("aisles", files.AISLES), "aisle_id", "left")
    products = lookup_join(products, table("departments", files.DEPARTMENTS), "department_id", "left")
    given = table("orders", files.ORDERS)
    longest = longest_history(given)
    orders = conform(complete_orders(given, longest > GROUP_ROWS), ORDER_COLUMNS)
    orders = materialize(orders, "orders")
    lines = table("order_products__prior", files.ORDER_PRODUCTS).unionByName(
        table("order_products__train", files.ORDER_PRODUCTS)
    )
    placed = materialize_bucketed(conform(place_lines(lines, orders, longest > GROUP_ROWS), LINE_COLUMNS), "lines", PAIR)
    products = materialize(conform(products, PRODUCT_COLUMNS), "products")
    return Baskets(products, orders, placed, longest, test_lines=False)


def from_log(log: DataFrame) -> Baskets:
    """Baskets from a purchase log with a calendar date per line (see ``files.read_log``).

    The log's order ids number the orders of a user, so user and number together name an order;
    the newest order of a user is the target. Cart positions are ranks of the product id. Names, categories and
    hours are not in a log and stay NULL; a user's products without a category form one category.
    """
    order_id = F.concat_ws("_", "user_id", "order_id")
    keyed = log.withColumns({"order_number": F.col("order_id"), "order_id": order_id})
    given = keyed.groupBy("order_id", "user_id", "order_number").agg(
        F.min("visit_date").alias("order_date"),
        F.when(F.min("train_test") > 1, PRIOR).otherwise(TRAIN).alias("eval_set"),
        F.min("days_since_prior_order").alias("days_since_prior_order"),
        F.min("order_dow").alias("order_dow"),
        F.lit(None).cast("int").alias("order_hour_of_day"),
    )
    given = materialize(given, "given")
    longest = longest_history(given)
    orders = materialize(conform(complete_orders(given, longest > GROUP_ROWS), ORDER_COLUMNS), "orders")
    cart = Window.partitionBy("order_id").orderBy("product_id")
    lines = (
        keyed.groupBy("order_id", "product_id")
        .agg(F.sum("units").alias("units"), F.sum("dollars").alias("dollars"), F.max("reordered").alias("reordered"))
        .withColumn("add_to_cart_order", F.dense_rank().over(cart))
    )
    parts = parts_of(log.sparkSession, log.count())
    placed = conform(place_lines(lines, orders, longest > GROUP_ROWS, parts), LINE_COLUMNS)
    placed = materialize_bucketed(placed, "lines", PAIR, buckets=parts)
    products = conform(placed.select("product_id").distinct(), PRODUCT_COLUMNS)
    return Baskets(materialize(products, "products"), orders, placed, longest)


def save(b: Baskets, folder: str) -> None:
    """Keep baskets at ``folder`` for other sessions, lines in buckets by user and product."""
    spark = b.products.sparkSession
    b.products.write.parquet(f"{folder}/products")
    b.orders.write.parquet(f"{folder}/orders")
    buckets = spark.conf.get("spark.sql.shuffle.partitions")
    # With as many partitions as buckets each bucket is one file.
    materialize_bucketed(b.lines.repartition(int(buckets), *PAIR), "lines", PAIR, f"{folder}/lines")
    facts = spark.range(1).select(
        F.lit(b.longest).alias("longest"), F.lit(b.test_lines).alias("test_lines"), F.lit(int(buckets)).alias("buckets")
    )
    facts.write.parquet(f"{folder}/facts")


def open_saved(spark: SparkSession, folder: str) -> Baskets:
    """Baskets kept by :func:`save`; nothing is derived or moved again."""
    facts = spark.read.parquet(f"{folder}/facts").first()
    return Baskets(
        spark.read.parquet(f"{folder}/products"),
        spark.read.parquet(f"{folder}/orders"),
        open_bucketed(spark, f"{folder}/lines", PAIR, facts.buckets),
        facts.longest,
        facts.test_lines,
    )
