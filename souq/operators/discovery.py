"""Home-page discovery queries (O-01 .. O-04, J-01, J-02, J-04, A-01, P-01, P-04, P-10).

Plan shape used throughout, all of it lazy: filter and join the product
table, pick the k rows (``TakeOrderedAndProject``: each task keeps its own top
k), and only then look up images and descriptions, each reduced to those k
keys by a semi-join before it is grouped or joined.  No join carries a hint:
the planner and AQE broadcast a side (the k rows, the businesses) only while
its size is under the threshold and fall back to a sort-merge join beyond it.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souq.functions.pricing import discounted_price


def has_primary_flag(images: DataFrame) -> bool:
    """P-10 schema probe: the primary-image predicate is used only if the column exists."""
    return "is_primary" in images.columns


def primary_images(images: DataFrame, primary_only: bool | None = None) -> DataFrame:
    """P-10: images eligible as the card image (``is_primary = 1`` when available)."""
    if primary_only is None:
        primary_only = has_primary_flag(images)
    if primary_only:
        images = images.where(F.col("is_primary").cast("int") == 1)
    return images


def image_order(images: DataFrame) -> Column:
    # The source's LIMIT 1 has no ORDER BY; we fix (display_order, image_id).
    cols = [c for c in ("display_order", "image_id") if c in images.columns]
    return F.struct(*cols) if cols else F.struct(F.col("image_path"))


def first_image(images: DataFrame, primary_only: bool | None = None) -> DataFrame:
    """J-04 for every product: (product_id, image).

    A grouped ``min_by`` rather than a window: the aggregate (sort-based,
    since the ordering key is a struct) still combines partially on the map
    side, so a product with a huge number of images costs one row per task
    before the shuffle.
    """
    imgs = primary_images(images, primary_only)
    return imgs.groupBy("product_id").agg(F.min_by("image_path", image_order(imgs)).alias("image"))


def keys_of(top: DataFrame, key: str = "product_id") -> DataFrame:
    """The keys of a top-k or page, read through all its columns.

    A plan that only takes the keys would read fewer columns below, and so
    could not share its exchanges with the plan of the rows: the tables would
    be read and grouped once more.  The condition holds for every row.
    """
    whole = F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in top.columns])
    return top.where(F.length(whole) >= 0).select(key)


def attach_first_image(top: DataFrame, images: DataFrame, primary_only: bool | None = None,
                       name: str = "image", keys: DataFrame | None = None) -> DataFrame:
    """J-04 for the rows of a top-k: one image per row, NULL if none.

    Images are reduced to the given products by a semi-join first, whose k
    keys AQE broadcasts, so no other image is shuffled.
    """
    keys = keys_of(top) if keys is None else keys
    imgs = primary_images(images, primary_only).join(keys, "product_id", "left_semi")
    best = imgs.groupBy("product_id").agg(F.min_by("image_path", image_order(imgs)).alias(name))
    return top.join(best, "product_id", "left")


def attach_description(top: DataFrame, product_text: DataFrame) -> DataFrame:
    """Add ``description`` to the rows of a top-k; texts are reduced by a semi-join before they move."""
    t = product_text.select("product_id", "description").join(keys_of(top), "product_id", "left_semi")
    return top.join(t, "product_id", "left")


def with_business_name(products: DataFrame, businesses: DataFrame) -> DataFrame:
    """J-01 + P-01: ``p.*, b.business_name`` over an inner join (orphans drop out)."""
    return products.join(businesses.select("business_id", "business_name"), "business_id") \
                   .select(*[F.col(c) for c in products.columns], "business_name")


def _decorate(top: DataFrame, images: DataFrame, product_text: DataFrame | None,
              order: list[Column]) -> DataFrame:
    out = top if product_text is None else attach_description(top, product_text)
    return attach_first_image(out, images, keys=keys_of(top)).select(
        *top.columns, *(["description"] if product_text is not None else []), "image").orderBy(*order)


def newest_products(products: DataFrame, businesses: DataFrame, images: DataFrame,
                    product_text: DataFrame | None = None, k: int = 8) -> DataFrame:
    """O-01: newest k products with business name and card image."""
    order = [F.desc("created_at"), F.asc("product_id")]
    top = with_business_name(products, businesses).orderBy(*order).limit(k)
    return _decorate(top, images, product_text, order)


def top_deals(products: DataFrame, businesses: DataFrame, images: DataFrame,
              product_text: DataFrame | None = None, k: int = 4) -> DataFrame:
    """O-02: the k largest positive discounts with the discounted price (X-01)."""
    order = [F.desc("discount_percent"), F.asc("product_id")]
    deals = products.where(F.col("discount_percent") > 0)                      # P-04
    top = (with_business_name(deals, businesses)
           .withColumn("discounted_price", discounted_price("price", "discount_percent"))
           .orderBy(*order).limit(k))
    return _decorate(top, images, product_text, order)


def trending(products: DataFrame, businesses: DataFrame, images: DataFrame,
             product_text: DataFrame | None = None, k: int = 8, seed: int | None = 42) -> DataFrame:
    """O-04: k random products.

    With a seed the order is ``md5(product_id || '-' || seed)``: repeatable and
    identical in any engine with md5.  ``seed=None`` draws a seed per call, like
    the source's ``ORDER BY RAND()`` (``rand()`` itself could give every lookup
    of the lazy plan other rows).  Either way it is a top-k, never a full sort.
    """
    seed = random.getrandbits(63) if seed is None else seed
    key = F.md5(F.concat(F.col("product_id").cast("string"), F.lit("-"), F.lit(str(seed))))
    top = (with_business_name(products, businesses).withColumn("_rk", key)
           .orderBy("_rk", "product_id").limit(k))
    out = _decorate(top, images, product_text, [F.col("_rk"), F.col("product_id")])
    return out.drop("_rk")


def business_product_counts(businesses: DataFrame, products: DataFrame) -> DataFrame:
    """A-01 + J-02: every business with ``COUNT(p.product_id)`` (0 when none, T-04).

    Products are counted per business first (partial aggregation, so a seller
    holding a third of all products costs one row per task), then joined back.
    """
    counts = products.where(F.col("business_id").isNotNull()) \
                     .groupBy("business_id").agg(F.count("product_id").alias("product_count"))
    return businesses.join(counts, "business_id", "left") \
                     .withColumn("product_count", F.coalesce("product_count", F.lit(0).cast("bigint")))


def newest_businesses(businesses: DataFrame, products: DataFrame, k: int = 4) -> DataFrame:
    """O-03: newest k businesses with their product counts.

    Hand rewrite (exact): neither sort key depends on products, so the k
    businesses are chosen first and only their products are counted.
    """
    order = [F.desc("created_at"), F.asc("business_id")]
    top = businesses.orderBy(*order).limit(k)
    counts = products.join(top.select("business_id"), "business_id", "left_semi") \
                     .groupBy("business_id").agg(F.count("product_id").alias("product_count"))
    return top.join(counts, "business_id", "left").select(
        *businesses.columns, F.coalesce("product_count", F.lit(0).cast("bigint")).alias("product_count")).orderBy(*order)
