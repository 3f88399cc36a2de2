"""Named queries: each takes (spark, folder of driver tables) and returns a DataFrame.

Every query reads the whole driver tables through ``MarketViews``; the
parameters below (k, page, search text, category) are the features of the
queries, not sampling.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from souq.functions.labels import BUSINESS_CATEGORIES
from souq.functions.text import slugify
from souq.operators import (catalog, discovery, history, intake, integrity, labels, rank_index, reports, reviews,
                            rollups, taxonomy, text_index)
from souq.plans import candidates
from souq.session import scratch_path
from souq.sources.dialect import resolve_columns
from souq.sources.versions import VersionedTable
from souq.sources.views import MarketViews

QueryFn = Callable[[SparkSession, str], DataFrame]

TRENDING_SEED = 42
# Seller-catalog request used by the batch (all sellers) catalog queries.
SEARCH_TEXT = "red"
SEARCH_CATEGORY = 2          # a root category: itself plus its children
CATALOG_PAGE = 2
SELLER = 3
INDEXED_SEARCHES = [" red ", "ATION", "th_s", "o%ation", "und der", "zz", "_e_r", "0", "100\\%"]


def _mv(spark: SparkSession, d: str) -> MarketViews:
    return MarketViews(spark, d)      # a fresh listing: appended files are seen


def q_top_deals(spark, d):
    v = _mv(spark, d)
    return discovery.top_deals(v.products, v.businesses, v.product_images, v.product_text, k=4)


def q_newest_products(spark, d):
    v = _mv(spark, d)
    return discovery.newest_products(v.products, v.businesses, v.product_images, v.product_text, k=8)


def q_trending_sample(spark, d):
    v = _mv(spark, d)
    return discovery.trending(v.products, v.businesses, v.product_images, v.product_text,
                              k=8, seed=TRENDING_SEED)


def q_newest_businesses(spark, d):
    v = _mv(spark, d)
    return discovery.newest_businesses(v.businesses, v.products, k=4)


def q_business_product_counts(spark, d):
    v = _mv(spark, d)
    return discovery.business_product_counts(v.businesses, v.products)


def q_product_images(spark, d):
    v = _mv(spark, d)
    return discovery.first_image(v.product_images)


def q_category_tree(spark, d):
    return taxonomy.category_tree_rows(_mv(spark, d).categories, order_by_name=True)


def q_category_names(spark, d):
    return taxonomy.category_names(_mv(spark, d).categories)


def q_category_products(spark, d):
    v = _mv(spark, d)
    return taxonomy.filter_by_category(v.products, v.categories, SEARCH_CATEGORY) \
                   .select("product_id", "business_id", "category_id", "name", "price", "created_at")


def q_category_product_counts(spark, d):
    v = _mv(spark, d)
    return taxonomy.category_product_counts(v.products, v.categories)


def q_catalog_page(spark, d):
    v = _mv(spark, d)
    return catalog.catalog_pages_all(v.products, v.categories, page=CATALOG_PAGE,
                                     product_text=v.product_text)


def q_catalog_search(spark, d):
    v = _mv(spark, d)
    return catalog.catalog_pages_all(v.products, v.categories, search=SEARCH_TEXT,
                                     category=SEARCH_CATEGORY, page=1, product_text=v.product_text)


def q_catalog_count(spark, d):
    v = _mv(spark, d)
    return catalog.catalog_counts_all(v.businesses, v.products, v.categories, search=SEARCH_TEXT,
                                      category=SEARCH_CATEGORY, product_text=v.product_text)


def q_sellers_without_business(spark, d):
    v = _mv(spark, d)
    return catalog.sellers_without_business(v.users, v.businesses)


def q_listing_labels(spark, d):
    v = _mv(spark, d)
    return labels.listing_labels(v.products, v.product_text)


def q_product_ratings(spark, d):
    v = _mv(spark, d)
    return reviews.product_ratings(v.products, v.product_reviews)


def q_product_intake(spark, d):
    v = _mv(spark, d)
    val = intake.validate_products(candidates.product_candidates(v))
    return val.select("arrival_no", "name", "category_id", F.col("price_value").alias("price"),
                      F.col("discount_value").alias("discount"),
                      F.array_join("errors", ",").alias("error_codes"),
                      (F.size("errors") == 0).alias("is_valid"))


def q_user_intake(spark, d):
    v = _mv(spark, d)
    return intake.validate_users(candidates.user_candidates(v), v.users)


def q_slug_collisions(spark, d):
    v = _mv(spark, d)
    return intake.slug_report(v.products, "name", "product_id")


def q_role_counts(spark, d):
    return intake.role_counts(_mv(spark, d).users)


MAPPED_TABLES = ["users", "businesses", "categories", "products", "product_images", "product_reviews",
                 "orders", "order_items", "cart_items", "wishlist_items", "forum_topics", "forum_posts"]


def _tables(v: MarketViews) -> dict[str, DataFrame]:
    return {t: v.table(t) for t in MAPPED_TABLES}


def _defective(spark, d, specs: list[dict] | None = None) -> dict[str, DataFrame]:
    """The defective tables; with ``specs``, those that the given lists of constraints name."""
    needed = None if specs is None else {k if isinstance(k, str) else k[0] for s in specs for k in s}
    return candidates.defective_tables(_mv(spark, d), [t for t in MAPPED_TABLES if needed is None or t in needed])


def q_orphans(spark, d):
    return integrity.orphan_audit(_defective(spark, d))


def q_duplicate_keys(spark, d):
    return integrity.key_audit(_defective(spark, d))


def q_enum_violations(spark, d):
    return integrity.enum_audit(_defective(spark, d, [integrity.ENUMS]))


def q_null_violations(spark, d):
    return integrity.null_audit(_defective(spark, d))


def q_length_violations(spark, d):
    return integrity.length_audit(_defective(spark, d, [integrity.VARCHAR_LIMITS, integrity.DECIMAL_SHAPES]))


def q_column_violations(spark, d):
    return integrity.column_audit(_defective(spark, d))


def q_delete_plan(spark, d):
    """Deleting every unverified user: cascades, SET NULLs and RESTRICT blocks."""
    v = _mv(spark, d)
    victims = v.users.where(~F.col("is_verified")).select("user_id")
    return integrity.plan_delete(_tables(v), "users", victims)


def q_owned_delete(spark, d):
    """Delete requests (product, seller) taken from returned order lines."""
    v = _mv(spark, d)
    req = v.order_items.where(F.col("status") == "returned").select("product_id", "business_id").distinct()
    return integrity.owned_delete(v.products, v.order_items, req)


def q_catalog_after_delete(spark, d):
    """S-04, J-08, S-09 on a stored table: accepted products are appended, some sellers delete theirs.

    Requests name returned order lines (blocked, or another seller's) and two
    thirds of the new products, which nobody has ordered, half of these by
    another seller.  Rows: each request's status, and the products left.
    """
    v = _mv(spark, d)
    cols = ["product_id", "business_id", "name"]
    new = q_accepted_products(spark, d).select(*cols)
    table = VersionedTable(spark, scratch_path(spark, f"souq/products-{uuid.uuid4().hex}"))
    table.append(v.products.select(*cols), "catalog")
    table.append(new, "intake")
    table.append(new, "intake")                        # a repeated job changes nothing
    k = F.col("product_id")
    added = table.read().join(v.products.select("product_id"), "product_id", "left_anti")
    requests = v.order_items.where(F.col("status") == "returned").select("product_id", "business_id").union(
        added.where(k % 3 != 2).select("product_id", F.col("business_id") + (k % 3))).distinct()
    status = integrity.delete_owned(table, v.order_items, requests, "requests")
    return status.unionByName(table.read().select("product_id", "business_id", F.lit("left").alias("status")))


def q_delete_survivors(spark, d):
    """Rows and remaining references per table after deleting the unblocked victims of ``delete_plan``."""
    v = _mv(spark, d)
    t = _tables(v)
    plan = integrity.plan_delete(t, "users", v.users.where(~F.col("is_verified")).select("user_id"))
    left = integrity.surviving_rows(t, plan)
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), integrity.key_sum(integrity.PRIMARY_KEYS[n]).alias("key_sum"))
             .select(F.lit(n).alias("table_name"), "rows", "key_sum") for n, df in left.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def q_seller_page(spark, d):
    """One seller's second page (P-02, O-05)."""
    v = _mv(spark, d)
    return catalog.seller_catalog(v.products, v.categories, business_id=SELLER, page=CATALOG_PAGE,
                                  product_text=v.product_text)["page"]


def q_indexed_search(spark, d):
    """P-03: searches of the descriptions by the trigram index (built here; a service keeps it)."""
    v = _mv(spark, d)
    index = text_index.TextIndex(spark, scratch_path(spark, f"souq/texts-{uuid.uuid4().hex}"))
    return text_index.searches(index.add(v.product_text, "product_id", "description"), INDEXED_SEARCHES)


def q_seller_last_page(spark, d):
    """O-05: the last page of the seller with the most products, by the rank index."""
    v = _mv(spark, d)
    index = rank_index.RankIndex(spark, scratch_path(spark, f"souq/ranks-{uuid.uuid4().hex}")).build(v.products)
    most = index.counts().orderBy(F.desc("total_products"), "business_id").limit(1).collect()
    page = index.page(most[0].business_id, most[0].total_pages) if most else index.page(0)
    return catalog.with_category_name(catalog.with_text(page, v.product_text), v.categories)


def q_seller_count(spark, d):
    v = _mv(spark, d)
    return catalog.seller_catalog(v.products, v.categories, business_id=SELLER,
                                  product_text=v.product_text)["count"]


def q_category_seed(spark, d):
    """S-03: every part's type appended below the brand that its slug names; one in six names none."""
    part = _mv(spark, d).raw("part")
    k = F.col("p_partkey")
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("bigint")
    brands = part.select(number.alias("category_id"), F.col("p_brand").alias("category_name"),
                         slugify("p_brand").alias("category_slug"), F.lit(None).cast("bigint").alias("parent_id")).distinct()
    children = part.select(
        (k + 1).cast("bigint").alias("seq"), F.concat("p_type", F.lit(" "), k.cast("string")).alias("category_name"),
        slugify(F.concat("p_type", F.lit(" "), k.cast("string"))).alias("category_slug"),
        F.when(k % 6 == 5, F.lit("no-such-slug")).otherwise(slugify("p_brand")).alias("parent_slug"))
    return taxonomy.add_children_by_parent_slug(brands, children).select(
        "category_id", "category_name", "category_slug", "parent_id")


def q_dialect2_catalog(spark, d):
    """S-06: products with the bare column names of the second dialect, resolved, then counted per category."""
    v = _mv(spark, d)
    bare = v.products.withColumnsRenamed({"product_id": "id", "discount_percent": "discount"})
    cats = v.categories.withColumnsRenamed({"category_id": "id", "category_name": "name"})
    return taxonomy.category_product_counts(resolve_columns(bare, "products"), resolve_columns(cats, "categories"))


def q_accepted_products(spark, d):
    """S-04 + X-15: rows the intake would append (fixed clock, without NOW())."""
    v = _mv(spark, d)
    rows = intake.accepted_products(intake.validate_products(candidates.product_candidates(v)), v.products,
                                    epoch=F.lit(1700000000))
    return rows.select("product_id", "business_id", "category_id", "name", "slug", "price", "discount_percent",
                       "image_path", F.md5("description").alias("description_md5"))


def q_accepted_users(spark, d):
    """S-05: accounts the intake would append (without NOW())."""
    v = _mv(spark, d)
    rows = intake.accepted_users(intake.validate_users(candidates.user_candidates(v), v.users), v.users)
    return rows.select("user_id", "first_name", "last_name", "email", "phone", "role", "username", "is_verified")


def q_allocated_usernames(spark, d):
    """S-05 + X-14: usernames of a batch in which a third share one name, against a table that uses many numbers."""
    batch, users = candidates.namesake_users(_mv(spark, d))
    return intake.allocate_usernames(batch, users).select("arrival_no", "username")


def q_assigned_slugs(spark, d):
    """V-03: slugs unique in the batch and against the table."""
    batch, table = candidates.namesake_products(_mv(spark, d))
    return intake.assign_slugs(batch, table, "name")


def q_unread_counts(spark, d):
    """C-13: conversation turns as messages, error events as notifications."""
    v = _mv(spark, d)
    m = v.raw("conversations").select(F.col("conv_id").alias("receiver_id"),
                                      (F.col("turn") % 2 == 0).cast("int").alias("is_read"))
    n = v.raw("events").where("event_type = 'error'").select("user_id", (F.col("event_id") % 3 == 0).cast("int")
                                                             .alias("is_read"))
    return reports.unread_counts(m, n)


def q_discount_migration(spark, d):
    """Second-dialect products (both discount columns) migrated to ``discount``."""
    v = _mv(spark, d)
    k = F.col("product_id")
    legacy = F.when(k % 3 == 0, F.lit(0)).when(k % 3 == 1, F.lit(None)) \
              .otherwise(F.col("stock_quantity")).cast(DecimalType(5, 2))
    both = v.products.withColumn("discount", legacy)
    return integrity.discount_migration(both).select("product_id", "discount")


CATEGORY_SLUG = "america"


def q_browse_facets(spark, d):
    return reports.browse_facets(_mv(spark, d).products)


def q_trending_by_sales(spark, d):
    return reports.trending_by_sales(_mv(spark, d).products, k=8)


def q_category_page(spark, d):
    v = _mv(spark, d)
    return reports.category_page(v.products, v.categories, CATEGORY_SLUG)


def q_product_detail(spark, d):
    v = _mv(spark, d)
    return reports.product_detail(v.products, v.product_images, v.product_reviews)


def q_product_detail_lists(spark, d):
    """C-03: first rows of every product's images, attributes (brand, type, size) and tags (words of the name)."""
    v = _mv(spark, d)
    p = v.raw("part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    k = F.col("p_partkey")
    attributes = p.select(k.alias("product_id"), F.posexplode(F.array(*(
        F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value"))
        for n, c in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"))))).alias("at", "x"))
    attributes = attributes.select("product_id", (F.col("product_id") * 4 + F.col("at")).alias("attribute_id"),
                                   F.col("x.name").alias("attribute_name"), F.col("x.value").alias("attribute_value"),
                                   (2 - F.col("at")).alias("display_order"))
    tags = p.select(k.alias("product_id"), F.posexplode(F.split("p_name", " ")).alias("at", "tag_name"))
    tags = tags.select("product_id", (F.col("product_id") * 100 + F.col("at")).alias("tag_id"), "tag_name")
    return reports.product_detail_lists(v.product_images, attributes, tags)


def q_refreshed_ratings(spark, d):
    """A-03 + A-04 kept by signed changes: reviews come, some are edited, some hidden, new ones follow."""
    v = _mv(spark, d)
    k = F.col("review_id")
    r = v.product_reviews.select("review_id", "product_id", "rating", "is_hidden")
    edited = r.withColumn("rating", F.when(k % 7 == 0, 6 - F.col("rating")).otherwise(F.col("rating")))
    rollup = rollups.rating_rollup(spark, scratch_path(spark, f"souq/ratings-{uuid.uuid4().hex}"))
    shown = ~F.col("is_hidden")
    rollup.commit(r.where(shown).withColumn("sign", F.lit(1)), "load")
    for _ in range(2):                                 # the job runs twice
        rollup.commit(rollups.changes(r.where(shown & (k % 7 == 0)), edited.where(shown & (k % 7 == 0))), "edits")
    rollup.commit(edited.where(shown & (k % 11 == 0)).withColumn("sign", F.lit(-1)), "hidden")
    rollup.compact()
    rollup.commit(r.where(k % 5 == 0).withColumns({"rating": F.lit(5), "sign": F.lit(1)}), "new")
    return rollups.ratings(rollup, v.products)


def q_refreshed_sales(spark, d):
    """C-09 kept by signed changes: order lines come, one in six orders is returned."""
    v = _mv(spark, d)
    lines = v.order_items.select("order_id", "product_id", "quantity", "status")
    rollup = rollups.sales_rollup(spark, scratch_path(spark, f"souq/sales-{uuid.uuid4().hex}"))
    rollup.commit(lines.withColumn("sign", F.lit(1)), "load")
    back = lines.where(F.col("order_id") % 6 == 0)
    rollup.commit(rollups.changes(back, back.withColumn("status", F.lit("returned"))), "returns")
    return rollups.total_sales(rollup, v.products)


def q_order_history_rows(spark, d):
    """C-05: every customer's orders, newest first, from the layout bucketed by customer."""
    v = _mv(spark, d)
    name = f"order_history_{uuid.uuid4().hex}"
    stored = history.store_history(v.orders, v.order_items, name, scratch_path(spark, f"souq/{name}"))
    return history.order_pages(stored)


def q_cart_totals(spark, d):
    v = _mv(spark, d)
    return reports.cart_totals(v.cart_items, v.products)


def q_order_history(spark, d):
    v = _mv(spark, d)
    return reports.order_history(v.orders, v.order_items)


def q_order_funnel(spark, d):
    return reports.order_funnel(_mv(spark, d).orders)


def q_order_reconciliation(spark, d):
    v = _mv(spark, d)
    return reports.order_reconciliation(v.orders, v.order_items)


def q_seller_sales(spark, d):
    return reports.seller_sales(_mv(spark, d).order_items)


def q_total_sales_refresh(spark, d):
    v = _mv(spark, d)
    return reports.refresh_total_sales(v.products, v.order_items)


def q_platform_stats(spark, d):
    v = _mv(spark, d)
    return reports.platform_stats(v.users, v.businesses, v.orders)


def q_verified_reviews(spark, d):
    v = _mv(spark, d)
    return reports.verified_reviews(v.product_reviews, v.orders, v.order_items)


def q_topic_activity(spark, d):
    v = _mv(spark, d)
    return reports.topic_activity(v.forum_topics, v.forum_posts)


def q_wishlist_top(spark, d):
    v = _mv(spark, d)
    return reports.wishlist_popularity(v.wishlist_items, v.products, k=10)


def q_seller_business(spark, d):
    v = _mv(spark, d)
    return catalog.seller_business(v.users, v.businesses)


def q_business_cards(spark, d):
    """Logos, locations and category codes by key residue, so that every fallback is reached (J-10, X-13)."""
    k = F.col("business_id")
    b = _mv(spark, d).businesses.withColumns({
        "logo_path": F.when(k % 3 == 0, F.concat(F.lit("logos/"), k.cast("string"))),
        "business_category": F.element_at(F.array(*[F.lit(c) for c in [*BUSINESS_CATEGORIES, "other-code", ""]]),
                                          (k % (len(BUSINESS_CATEGORIES) + 2) + 1).cast("int")),
        "city": F.when(k % 4 != 0, F.col("city")),
        "location": F.when(k % 8 == 0, F.concat(F.lit("near "), F.col("state")))})
    return labels.business_cards(b)


QUERIES: dict[str, QueryFn] = {
    "top_deals": q_top_deals,
    "newest_products": q_newest_products,
    "trending_sample": q_trending_sample,
    "newest_businesses": q_newest_businesses,
    "business_product_counts": q_business_product_counts,
    "first_images": q_product_images,
    "category_tree": q_category_tree,
    "category_names": q_category_names,
    "category_products": q_category_products,
    "category_product_counts": q_category_product_counts,
    "catalog_page": q_catalog_page,
    "catalog_search": q_catalog_search,
    "catalog_count": q_catalog_count,
    "sellers_without_business": q_sellers_without_business,
    "seller_business": q_seller_business,
    "business_cards": q_business_cards,
    "listing_labels": q_listing_labels,
    "product_ratings": q_product_ratings,
    "product_intake": q_product_intake,
    "user_intake": q_user_intake,
    "slug_collisions": q_slug_collisions,
    "role_counts": q_role_counts,
    "orphans": q_orphans,
    "duplicate_keys": q_duplicate_keys,
    "enum_violations": q_enum_violations,
    "null_violations": q_null_violations,
    "length_violations": q_length_violations,
    "column_violations": q_column_violations,
    "delete_plan": q_delete_plan,
    "owned_delete": q_owned_delete,
    "discount_migration": q_discount_migration,
    "browse_facets": q_browse_facets,
    "trending_by_sales": q_trending_by_sales,
    "category_page": q_category_page,
    "product_detail": q_product_detail,
    "cart_totals": q_cart_totals,
    "order_history": q_order_history,
    "order_funnel": q_order_funnel,
    "order_reconciliation": q_order_reconciliation,
    "seller_sales": q_seller_sales,
    "total_sales_refresh": q_total_sales_refresh,
    "platform_stats": q_platform_stats,
    "verified_reviews": q_verified_reviews,
    "topic_activity": q_topic_activity,
    "wishlist_top": q_wishlist_top,
    "delete_survivors": q_delete_survivors,
    "seller_page": q_seller_page,
    "seller_count": q_seller_count,
    "category_seed": q_category_seed,
    "dialect2_catalog": q_dialect2_catalog,
    "accepted_products": q_accepted_products,
    "accepted_users": q_accepted_users,
    "unread_counts": q_unread_counts,
    "allocated_usernames": q_allocated_usernames,
    "assigned_slugs": q_assigned_slugs,
    "catalog_after_delete": q_catalog_after_delete,
    "indexed_search": q_indexed_search,
    "seller_last_page": q_seller_last_page,
    "product_detail_lists": q_product_detail_lists,
    "refreshed_ratings": q_refreshed_ratings,
    "refreshed_sales": q_refreshed_sales,
    "order_history_rows": q_order_history_rows,
}
