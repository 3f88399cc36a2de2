"""Marketplace reports declared by the schema and pages but absent from the
source's SQL (C-01 .. C-14).  The semantics here are ours.

Every report aggregates the large side (order items, reviews, cart rows)
per key before joining it to anything, so partial aggregation absorbs hot
keys on the map side and joins see one row per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from souq.operators.catalog import with_category_name
from souq.operators.discovery import has_primary_flag, image_order
from souq.operators.reviews import rating_stats, with_mean_rating

MONEY = DecimalType(18, 2)
#: Rows of a list on the product page.
DETAIL_ROWS = 4
CLOSED_ITEM_STATUSES = ["cancelled", "returned"]


def browse_facets(products: DataFrame) -> DataFrame:
    """C-01: the deal, featured and active facet sizes in one pass."""
    return products.agg(
        F.count_if(F.col("discount_percent") > 0).alias("deal_products"),
        F.count_if(F.col("is_featured").cast("int") == 1).alias("featured_products"),
        F.count_if(F.col("is_active").cast("int") == 1).alias("active_products"),
        F.count(F.lit(1)).alias("all_products"))


def trending_by_sales(products: DataFrame, k: int = 8) -> DataFrame:
    """C-01 ``trending=1``: the k best sellers (total_sales, then product_id)."""
    return products.orderBy(F.desc("total_sales"), F.asc("product_id")).limit(k) \
                   .select("product_id", "name", "total_sales")


def category_page(products: DataFrame, categories: DataFrame, slug: str) -> DataFrame:
    """C-02: products of the category with this slug or of its children."""
    own = categories.where(F.col("category_slug") == slug).select("category_id")
    kids = categories.join(own.withColumnRenamed("category_id", "parent_id"), "parent_id", "left_semi") \
                     .select("category_id")
    p = products.join(own.unionByName(kids), "category_id", "left_semi")
    return with_category_name(p, categories).select("product_id", "name", "price", "category_id", "category_name")


def product_detail(products: DataFrame, images: DataFrame, reviews: DataFrame,
                   attributes: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """C-03: per product image count, card image, rating summary and (when the
    tables are given) attribute and tag counts.

    Child tables are reduced to one row per product before the joins; no
    per-product list is gathered, so a product with a huge number of child
    rows costs no more than any other.
    """
    def counted(df, name):
        return df.groupBy("product_id").agg(F.count(F.lit(1)).alias(name))
    stats = with_mean_rating(rating_stats(reviews)).select("product_id", "avg_rating", "review_count")
    order = image_order(images)
    if has_primary_flag(images):
        order = F.when(F.col("is_primary").cast("int") == 1, order)
    shown = images.groupBy("product_id").agg(F.count(F.lit(1)).alias("image_count"),
                                             F.min_by("image_path", order).alias("image"))
    p = products.select("product_id", "name") \
                .join(shown, "product_id", "left") \
                .join(stats, "product_id", "left")
    extra = []
    for df, name in ((attributes, "attribute_count"), (tags, "tag_count")):
        if df is not None:
            p = p.join(counted(df, name), "product_id", "left")
            extra.append(F.coalesce(name, F.lit(0).cast("bigint")).alias(name))
    return p.select("product_id", "name",
                    F.coalesce("image_count", F.lit(0).cast("bigint")).alias("image_count"),
                    F.col("image").alias("primary_image"),
                    F.coalesce("avg_rating", F.lit(0).cast("decimal(4,1)")).alias("avg_rating"),
                    F.coalesce("review_count", F.lit(0).cast("bigint")).alias("review_count"), *extra)


def product_detail_lists(images: DataFrame, attributes: DataFrame, tags: DataFrame, page: int = 1,
                         page_size: int = DETAIL_ROWS) -> DataFrame:
    """C-03 as rows: a page of every product's images, attributes and tags, with the totals to page on.

    (product_id, kind, position, item_id, name, value, total).  The three child
    tables are one tagged union ranked by one window; each task passes on
    offset + page_size rows of a product's list at most, and the totals are
    counted on the map side, so no list is gathered whole.
    """
    text = lambda c: F.col(c).cast("string")
    order = F.coalesce("display_order", F.lit(0)).cast("bigint").alias("_order")
    rows = [images.select("product_id", F.lit("image").alias("kind"), order, F.col("image_id").alias("item_id"),
                          F.lit(None).cast("string").alias("name"), text("image_path").alias("value")),
            attributes.select("product_id", F.lit("attribute").alias("kind"), order, F.col("attribute_id").alias("item_id"),
                              text("attribute_name").alias("name"), text("attribute_value").alias("value")),
            tags.select("product_id", F.lit("tag").alias("kind"), F.lit(0).cast("bigint").alias("_order"),
                        F.col("tag_id").alias("item_id"), F.lit(None).cast("string").alias("name"),
                        text("tag_name").alias("value"))]
    every = reduce(DataFrame.unionByName, rows)
    lo = (max(1, page) - 1) * page_size
    w = Window.partitionBy("product_id", "kind").orderBy("_order", "item_id")
    listed = every.withColumn("position", F.row_number().over(w)).where(
        (F.col("position") > lo) & (F.col("position") <= lo + page_size))
    totals = every.groupBy("product_id", "kind").agg(F.count(F.lit(1)).alias("total"))
    return listed.join(totals, ["product_id", "kind"]).select(
        "product_id", "kind", F.col("position").cast("bigint").alias("position"), "item_id", "name", "value", "total")


def cart_totals(cart_items: DataFrame, products: DataFrame) -> DataFrame:
    """C-04: per user the cart lines, units and value at current prices."""
    priced = cart_items.join(products.select("product_id", "price"), "product_id", "left")
    return priced.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("cart_lines"),
        F.sum("quantity").cast("bigint").alias("cart_units"),
        F.sum(F.col("quantity") * F.col("price")).cast(MONEY).alias("cart_value"))


def order_history(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """C-05: per customer the order count, first/last order date, spend and lines."""
    lines = order_items.groupBy("order_id").agg(F.count(F.lit(1)).alias("_lines"))
    o = orders.join(lines, "order_id", "left")
    return o.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.min("created_at").alias("first_order_at"),
        F.max("created_at").alias("last_order_at"),
        F.sum("total_amount").cast(MONEY).alias("total_spent"),
        F.coalesce(F.sum("_lines"), F.lit(0)).cast("bigint").alias("order_lines"))


def order_funnel(orders: DataFrame) -> DataFrame:
    """C-06: orders and amount per (order_status, payment_status)."""
    return orders.groupBy("order_status", "payment_status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_amount").cast(MONEY).alias("amount"))


def order_reconciliation(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """C-07: orders whose items do not add up to the subtotal, or whose
    subtotal + shipping + tax - discount differs from the total."""
    items = order_items.groupBy("order_id").agg(F.sum("total_amount").cast(MONEY).alias("items_total"))
    o = orders.join(items, "order_id", "left") \
              .withColumn("items_total", F.coalesce("items_total", F.lit(0).cast(MONEY)))
    expected = (F.col("subtotal") + F.col("shipping_cost") + F.col("tax_amount")
                - F.col("discount_amount")).cast(MONEY)
    o = o.select("order_id", "subtotal", "items_total",
                 (F.col("subtotal") - F.col("items_total")).cast(MONEY).alias("items_gap"),
                 (F.col("total_amount") - expected).cast(MONEY).alias("total_gap"))
    return o.where((F.col("items_gap") != 0) | (F.col("total_gap") != 0))


def seller_sales(order_items: DataFrame) -> DataFrame:
    """C-08: per seller revenue, units and distinct orders (closed lines excluded).

    Two levels of grouping instead of ``countDistinct`` (which would expand
    every line into two rows): lines combine per (seller, order) on the map
    side, then orders per seller.
    """
    live = order_items.where(~F.col("status").isin(CLOSED_ITEM_STATUSES))
    per_order = live.groupBy("business_id", "order_id").agg(
        F.sum("total_amount").alias("_rev"), F.sum("quantity").alias("_units"))
    return per_order.groupBy("business_id").agg(
        F.sum("_rev").cast(MONEY).alias("revenue"),
        F.sum("_units").cast("bigint").alias("units"),
        F.count(F.lit(1)).alias("orders"))


def refresh_total_sales(products: DataFrame, order_items: DataFrame) -> DataFrame:
    """C-09: total_sales recomputed as units on live order lines (0 when none)."""
    units = order_items.where(~F.col("status").isin(CLOSED_ITEM_STATUSES)) \
                       .groupBy("product_id").agg(F.sum("quantity").cast("bigint").alias("units"))
    return products.select("product_id").join(units, "product_id", "left") \
                   .select("product_id", F.coalesce("units", F.lit(0).cast("bigint")).alias("total_sales"))


def platform_stats(users: DataFrame, businesses: DataFrame, orders: DataFrame) -> DataFrame:
    """C-10: (metric_group, metric_key, value) counts by role, status and order status."""
    def counts(df, group, col):
        return df.groupBy(F.col(col).alias("metric_key")).agg(F.count(F.lit(1)).alias("value")) \
                 .select(F.lit(group).alias("metric_group"), "metric_key", "value")
    return counts(users, "users_by_role", "role") \
        .unionByName(counts(businesses, "businesses_by_status", "status")) \
        .unionByName(counts(orders, "orders_by_status", "order_status"))


def verified_reviews(reviews: DataFrame, orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """C-11: a review is a verified purchase when its author ordered that product.

    Order lines are first cut to reviewed products (a semi-join against the
    distinct reviewed product ids), so only relevant lines meet the orders.
    """
    pairs = reviews.select("user_id", "product_id").distinct()
    lines = order_items.select("order_id", "product_id") \
                       .join(pairs.select("product_id").distinct(), "product_id", "left_semi")
    bought = lines.join(orders.select("order_id", "user_id"), "order_id") \
                  .join(pairs, ["user_id", "product_id"], "left_semi") \
                  .select("user_id", "product_id").distinct().withColumn("_bought", F.lit(True))
    r = reviews.select("review_id", "user_id", "product_id").join(bought, ["user_id", "product_id"], "left")
    return r.select("review_id", F.coalesce("_bought", F.lit(False)).alias("verified_purchase"))


def topic_activity(topics: DataFrame, posts: DataFrame) -> DataFrame:
    """C-12: per topic the post count and last post time (sticky topics first)."""
    agg = posts.groupBy("topic_id").agg(F.count(F.lit(1)).alias("posts"),
                                        F.max("created_at").alias("last_post_at"))
    t = topics.select("topic_id", "title", "is_sticky").join(agg, "topic_id", "left")
    return t.select("topic_id", "title", "is_sticky",
                    F.coalesce("posts", F.lit(0).cast("bigint")).alias("posts"), "last_post_at") \
            .orderBy(F.desc("is_sticky"), F.desc_nulls_last("last_post_at"), "topic_id")


def unread_counts(messages: DataFrame, notifications: DataFrame) -> DataFrame:
    """C-13: unread messages (by receiver) and notifications per user."""
    m = messages.where(F.col("is_read").cast("int") == 0).groupBy(F.col("receiver_id").alias("user_id")) \
                .agg(F.count(F.lit(1)).alias("unread_messages"))
    n = notifications.where(F.col("is_read").cast("int") == 0).groupBy("user_id") \
                     .agg(F.count(F.lit(1)).alias("unread_notifications"))
    return m.join(n, "user_id", "full").select(
        "user_id", F.coalesce("unread_messages", F.lit(0).cast("bigint")).alias("unread_messages"),
        F.coalesce("unread_notifications", F.lit(0).cast("bigint")).alias("unread_notifications"))


def wishlist_popularity(wishlist_items: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """C-14: the k most wished-for products (count, then product_id)."""
    counts = wishlist_items.groupBy("product_id").agg(F.count(F.lit(1)).alias("wishes"))
    top = counts.orderBy(F.desc("wishes"), F.asc("product_id")).limit(k)
    return top.join(products.select("product_id", "name"), "product_id", "left") \
              .select("product_id", "name", "wishes")
