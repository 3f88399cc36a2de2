"""Listing labels: every display rule of a product card or seller row,
computed for a whole product table in one projection (no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souq.functions.labels import (BUSINESS_PLACEHOLDER, business_category_label,
                                   image_or_placeholder, location_label)
from souq.functions.pricing import (discount_badge, discount_label, discounted_price,
                                    home_price_label, seller_deal_label, seller_price_label)
from souq.functions.text import date_label, slugify, truncate_text


def listing_labels(products: DataFrame, product_text: DataFrame | None = None,
                   teaser_length: int = 100) -> DataFrame:
    """X-01 .. X-07, X-12 for each product.

    The teaser comes from ``products.description`` when present, else from
    ``product_text``: there it is cut at the text scan, so only teasers of at
    most ``teaser_length`` bytes (plus the marker) are shuffled to the join,
    never whole texts.
    """
    if "description" not in products.columns and product_text is not None:
        teaser = product_text.select("product_id", truncate_text("description", teaser_length).alias("_teaser"))
        products = products.join(teaser, "product_id", "left")
        desc_teaser = F.col("_teaser")
    elif "description" in products.columns:
        desc_teaser = truncate_text("description", teaser_length)
    else:
        desc_teaser = F.lit(None).cast("string")
    pct = F.coalesce(F.col("discount_percent"), F.lit(0))   # X-13: a missing discount is 0
    return products.select(
        "product_id",
        home_price_label("price").alias("price_label"),
        home_price_label(discounted_price("price", pct)).alias("deal_price_label"),
        seller_price_label("price").alias("seller_price_label"),
        seller_deal_label("price", pct).alias("seller_deal_label"),
        discount_label(pct).alias("discount_label"),
        discount_badge(pct).alias("discount_badge"),
        date_label("created_at").alias("date_label"),
        desc_teaser.alias("teaser"),
        slugify("name").alias("name_slug"),
    )


def teasers(texts: DataFrame, column: str = "description", length: int = 100) -> DataFrame:
    """X-06 over a text table: whole texts in, one teaser per row out."""
    return texts.select("product_id", truncate_text(column, length).alias("teaser"),
                        F.octet_length(column).alias("text_bytes"))


def business_cards(businesses: DataFrame) -> DataFrame:
    """X-13 + J-10 for the business cards: logo or placeholder, location text
    and the category badge (no badge when the business has no category code)."""
    logo = F.col("logo_path") if "logo_path" in businesses.columns else F.lit(None).cast("string")
    code = F.col("business_category") if "business_category" in businesses.columns \
        else F.lit(None).cast("string")
    place = F.col("location") if "location" in businesses.columns else None
    return businesses.select(
        "business_id", "business_name",
        image_or_placeholder(logo, BUSINESS_PLACEHOLDER).alias("logo"),
        location_label("city", "state", place).alias("location"),
        business_category_label(code, badge=True).alias("category_badge"))
