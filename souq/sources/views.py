"""Marketplace tables derived from the driver's parquet tables.

The mapping is fixed (see FIXTURES.md section 3) and mirrored, column for
column, by the DuckDB views in ``souq.plans.oracle``.  Every view is a lazy
DataFrame: Catalyst prunes the columns a query does not use down to the
parquet scan, so e.g. a query that needs only ``products.business_id`` reads
two lineitem columns.

The only expensive view is ``products``: one aggregation of lineitem by part
key (partial aggregation on the map side, one shuffle on ``l_partkey``)
joined to ``part`` on the same key, which reuses that partitioning.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from souq.functions.text import slugify
from souq.sources.tables import scan


def _days_before(base: str, n: F.Column) -> F.Column:
    return F.date_sub(F.lit(base).cast("date"), n.cast("int")).cast("timestamp_ntz")


def _days_after(base: str, n: F.Column) -> F.Column:
    return F.date_add(F.lit(base).cast("date"), n.cast("int")).cast("timestamp_ntz")


# Surrogate keys packed into decimal digits without loss: (order, line) repeats in lineitem, the
# four parts together do not (order up to 13 digits, line 1, part and supplier 12 each).
ORDER_ITEM_ID = ("CAST(concat(CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
                 "lpad(CAST(l_partkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0')) "
                 "AS DECIMAL(38,0))")
USER_PRODUCT_ID = "CAST(concat(CAST(user_id AS STRING), lpad(CAST(product_id AS STRING), 12, '0')) AS DECIMAL(38,0))"

POST_ID = "CAST(concat(CAST(conv_id AS STRING), lpad(CAST(turn AS STRING), 12, '0')) AS DECIMAL(38,0))"


class MarketViews:
    """Lazy marketplace views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A driver table; its files are listed once for these views."""
        if name not in self._raw:
            self._raw[name] = scan(self.spark, self.base, name)
        return self._raw[name]

    # -- people and sellers -------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        key = F.col("c_custkey")
        return c.select(
            key.alias("user_id"),
            F.concat(F.lit("user"), key.cast("string")).alias("username"),
            F.col("c_name").alias("first_name"),
            F.col("c_mktsegment").alias("last_name"),
            F.concat(F.lit("u"), key.cast("string"), F.lit("@example.com")).alias("email"),
            (F.lit(9000000000) + key).cast("string").alias("phone"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "business_owner")
             .otherwise("customer").alias("role"),
            (F.col("c_acctbal") > 0).alias("is_verified"),
            _days_after("2019-01-01", key % 1000).alias("created_at"),
        )

    @cached_property
    def businesses(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        key = F.col("s_suppkey")
        return (s.join(n, s.s_nationkey == n.n_nationkey)
                 .join(r, F.col("n_regionkey") == r.r_regionkey)
                 .select(key.alias("business_id"), key.alias("user_id"),
                         F.col("s_name").alias("business_name"),
                         slugify(F.col("s_name")).alias("business_slug"),
                         F.col("n_name").alias("city"), F.col("r_name").alias("state"),
                         F.when(key % 10 == 0, "pending").otherwise("active").alias("status"),
                         _days_before("2020-01-01", key % 365).alias("created_at")))

    # -- catalog ------------------------------------------------------------
    @cached_property
    def categories(self) -> DataFrame:
        r, n = self.raw("region"), self.raw("nation")
        roots = r.select((F.col("r_regionkey") + 1).cast("bigint").alias("category_id"),
                         F.col("r_name").alias("category_name"),
                         F.lit(None).cast("bigint").alias("parent_id"),
                         F.col("r_regionkey").cast("int").alias("display_order"))
        kids = n.select((F.col("n_nationkey") + 100).cast("bigint").alias("category_id"),
                        F.col("n_name").alias("category_name"),
                        (F.col("n_regionkey") + 1).cast("bigint").alias("parent_id"),
                        F.col("n_nationkey").cast("int").alias("display_order"))
        return roots.unionByName(kids).select(
            "category_id", "category_name", slugify(F.col("category_name")).alias("category_slug"),
            "parent_id", F.lit(True).alias("is_active"), "display_order")

    def _part_rollup(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.groupBy("l_partkey").agg(
            F.min("l_suppkey").alias("business_id"),
            F.sum(F.round(F.col("l_discount") * 100).cast("int")).alias("disc_sum"),
            F.count(F.lit(1)).cast("int").alias("total_sales"),
            F.min("l_shipdate").alias("created_at"))

    @cached_property
    def products(self) -> DataFrame:
        """Products without the long ``description`` text (see ``product_text``)."""
        p = self.raw("part")
        roll = self._part_rollup()
        key = F.col("p_partkey")
        return p.join(roll, p.p_partkey == roll.l_partkey).select(
            key.alias("product_id"),
            F.col("business_id"),
            (F.lit(99) + F.regexp_extract("p_brand", "[0-9]+", 0).cast("bigint")).alias("category_id"),
            F.col("p_name").alias("name"),
            F.concat(slugify(F.col("p_name")), F.lit("-"), key.cast("string")).alias("slug"),
            F.col("p_retailprice").cast(DecimalType(10, 2)).alias("price"),
            F.col("p_size").cast("int").alias("stock_quantity"),
            (F.col("disc_sum") % 31).cast(DecimalType(5, 2)).alias("discount_percent"),
            (key % 7 == 0).alias("is_featured"),
            F.lit(True).alias("is_active"),
            F.col("total_sales"),
            F.col("created_at"),
        )

    @cached_property
    def product_text(self) -> DataFrame:
        """(product_id, description): product descriptions are document texts."""
        d = self.raw("documents")
        return d.select(F.col("doc_id").alias("product_id"), F.col("text").alias("description"))

    def products_with_description(self) -> DataFrame:
        """Products plus description (left join; NULL for parts without a document)."""
        return self.products.join(self.product_text, "product_id", "left")

    @cached_property
    def product_images(self) -> DataFrame:
        pg = self.raw("pages")
        return pg.select(F.col("page_id").alias("image_id"),
                         F.expr("page_id div 2").alias("product_id"),
                         F.col("url").alias("image_path"),
                         (F.col("page_id") % 2 == 1).alias("is_primary"),
                         (F.col("page_id") % 2).cast("int").alias("display_order"))

    @cached_property
    def product_reviews(self) -> DataFrame:
        e = self.raw("events")
        return e.select(F.col("event_id").alias("review_id"),
                        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("product_id"),
                        F.col("user_id"),
                        (F.lit(1) + F.floor("value").cast("int") % 5).cast("int").alias("rating"),
                        F.col("event_type").alias("review_text"),
                        (F.col("event_type") == "purchase").alias("is_verified_purchase"),
                        (F.col("event_type") == "error").alias("is_hidden"),
                        F.col("ts").alias("created_at"))

    # -- orders ---------------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        amount = F.col("o_totalprice").cast(DecimalType(12, 2))
        zero = F.lit(0).cast(DecimalType(12, 2))
        st = F.col("o_orderstatus")
        return o.select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
            F.when(st == "P", "pending").when(st == "O", "processing").when(st == "F", "delivered")
             .alias("order_status"),
            F.when(st == "F", "paid").otherwise("pending").alias("payment_status"),
            amount.alias("subtotal"), zero.alias("shipping_cost"), zero.alias("tax_amount"),
            zero.alias("discount_amount"), amount.alias("total_amount"),
            F.col("o_orderdate").alias("created_at"))

    @cached_property
    def order_items(self) -> DataFrame:
        li = self.raw("lineitem")
        price = F.col("l_extendedprice").cast(DecimalType(12, 2))
        disc = F.round(price * F.col("l_discount").cast(DecimalType(4, 2)), 2).cast(DecimalType(12, 2))
        return li.select(
            F.expr(ORDER_ITEM_ID).alias("order_item_id"),
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("business_id"),
            F.floor("l_quantity").cast("int").alias("quantity"),
            price.alias("price"), disc.alias("discount_amount"),
            (price - disc).cast(DecimalType(12, 2)).alias("total_amount"),
            F.when(F.col("l_returnflag") == "R", "returned")
             .when(F.col("l_linestatus") == "F", "delivered").otherwise("shipped").alias("status"),
            F.col("l_shipdate").alias("created_at"))

    def _event_pairs(self, event_type: str) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == event_type)
        pid = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
        return (e.select("user_id", pid.alias("product_id"), "ts")
                 .groupBy("user_id", "product_id")
                 .agg(F.count(F.lit(1)).cast("int").alias("quantity"), F.min("ts").alias("created_at")))

    @cached_property
    def cart_items(self) -> DataFrame:
        return self._event_pairs("click").select(
            F.expr(USER_PRODUCT_ID).alias("cart_item_id"),
            "user_id", "product_id", "quantity", "created_at")

    @cached_property
    def wishlist_items(self) -> DataFrame:
        return self._event_pairs("view").select(
            F.expr(USER_PRODUCT_ID).alias("wishlist_id"),
            "user_id", "product_id", "created_at")

    # -- community --------------------------------------------------------------
    @cached_property
    def forum_posts(self) -> DataFrame:
        c = self.raw("conversations")
        return c.select(
            F.expr(POST_ID).alias("post_id"),
            F.col("conv_id").alias("topic_id"), F.col("conv_id").alias("user_id"),
            F.col("text").alias("content"), (F.col("role") == "assistant").alias("is_solution"),
            (_days_after("2024-01-01", F.col("conv_id") % 365)
             + F.make_dt_interval(F.lit(0), F.col("turn").cast("int"))).alias("created_at"))

    @cached_property
    def forum_topics(self) -> DataFrame:
        c = self.raw("conversations").where(F.col("turn") == 0)
        return c.select(
            F.col("conv_id").alias("topic_id"),
            F.concat(F.lit("Topic "), F.col("conv_id").cast("string")).alias("title"),
            F.concat(F.lit("topic-"), F.col("conv_id").cast("string")).alias("slug"),
            F.col("conv_id").alias("created_by"),
            (F.col("conv_id") % 10 == 0).alias("is_sticky"),
            _days_after("2024-01-01", F.col("conv_id") % 365).alias("created_at"))

    def table(self, name: str) -> DataFrame:
        """A marketplace table by name (the S-01 scan over the mapping)."""
        return getattr(self, name)


VIEW_NAMES = ["users", "businesses", "categories", "products", "product_images", "product_reviews",
              "orders", "order_items", "cart_items", "wishlist_items", "forum_topics", "forum_posts"]

# Sort key inside each written file: row-group min/max statistics then let
# ``key IN (...)`` and range predicates skip most of a file.
LAYOUT_KEYS = {
    "users": "user_id", "businesses": "business_id", "categories": "category_id",
    "products": "product_id", "product_images": "product_id", "product_reviews": "product_id",
    "orders": "order_id", "order_items": "order_id", "cart_items": "user_id",
    "wishlist_items": "product_id", "forum_topics": "topic_id", "forum_posts": "topic_id",
}


class StoredViews:
    """Marketplace views read back from a folder written by ``materialize``.

    Same interface as ``MarketViews`` (attribute access, ``table``,
    ``products_with_description``); names that were not written (and
    ``product_text``, a plain projection of the raw documents) come from the
    lazy views.
    """

    def __init__(self, spark: SparkSession, path: str, fallback: MarketViews, names: list[str]):
        self.spark, self.path, self.fallback, self.names = spark, path, fallback, set(names)

    def table(self, name: str) -> DataFrame:
        if name in self.names:
            return self.spark.read.parquet(f"{self.path}/{name}")
        return self.fallback.table(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_NAMES or name == "product_text":
            return self.table(name)
        raise AttributeError(name)

    def products_with_description(self) -> DataFrame:
        return self.table("products").join(self.fallback.product_text, "product_id", "left")


def materialize(views: MarketViews, path: str, names: list[str] | None = None) -> StoredViews:
    """Write derived views once (e.g. to the shared checkpoint folder) and read them back.

    The expensive derivations (the lineitem rollup behind ``products``, the
    event rollups behind carts and wishlists) then run once for a whole
    workload instead of once per query.  Files are sorted by their lookup key
    within each task's output (no extra shuffle), which keeps row-group
    statistics narrow for key lookups.
    """
    names = list(names or VIEW_NAMES)
    for n in names:
        df = views.table(n)
        key = LAYOUT_KEYS.get(n)
        if key:
            df = df.sortWithinPartitions(key)
        df.write.mode("overwrite").parquet(f"{path}/{n}")
    return StoredViews(views.spark, path, views, names)
