"""Category hierarchy (J-05, J-06, P-06, P-07, O-06, S-03).

The source builds its two-level tree with one query per root (N+1); here it
is a single self-join.  Category tables are small, but nothing below assumes
it: the product-side work is always pre-aggregated before meeting them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_root(zero_is_root: bool = True) -> Column:
    """P-06: ``parent_id IS NULL OR parent_id = 0`` (or the stricter ``IS NULL``)."""
    c = F.col("parent_id").isNull()
    return c | (F.col("parent_id") == 0) if zero_is_root else c


def roots(categories: DataFrame, zero_is_root: bool = True) -> DataFrame:
    return categories.where(is_root(zero_is_root))


def _child_order(order_by_name: bool) -> list[Column]:
    if order_by_name:       # the form orders by name under a case-insensitive collation
        return [F.lower(F.col("child_name")), F.col("child_id")]
    return [F.col("child_id")]


def category_tree_rows(categories: DataFrame, zero_is_root: bool = True,
                       order_by_name: bool = False) -> DataFrame:
    """J-05 flattened: (root_id, root_name, child_id, child_name, child_position).

    A root without children yields one row with NULL child columns.  Exactly
    one level deep, like the source.
    """
    if "parent_id" not in categories.columns:       # flat fallback: every category is a root
        return categories.select(F.col("category_id").alias("root_id"),
                                 F.col("category_name").alias("root_name"),
                                 F.lit(None).cast("bigint").alias("child_id"),
                                 F.lit(None).cast("string").alias("child_name"),
                                 F.lit(None).cast("bigint").alias("child_position"))
    r = roots(categories, zero_is_root).select(F.col("category_id").alias("root_id"),
                                               F.col("category_name").alias("root_name"))
    c = categories.where(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("root_id"), F.col("category_id").alias("child_id"),
        F.col("category_name").alias("child_name"))
    t = r.join(c, "root_id", "left")
    w = Window.partitionBy("root_id").orderBy(*_child_order(order_by_name))
    pos = F.when(F.col("child_id").isNotNull(), F.row_number().over(w).cast("bigint"))
    return t.withColumn("child_position", pos)


def category_tree(categories: DataFrame, zero_is_root: bool = True,
                  order_by_name: bool = False) -> DataFrame:
    """J-05 nested: one row per root with ``children: array<struct<category_id, category_name>>``.

    Roots without children keep an empty array.  This gathers each root's
    children into one row, which is only meant for a taxonomy (tens to
    thousands of categories, the form's dropdown); anything that grows with
    the data should use the flat ``category_tree_rows``.
    """
    rows = category_tree_rows(categories, zero_is_root, order_by_name)
    child = F.when(F.col("child_id").isNotNull(),
                   F.struct(F.col("child_position").alias("pos"),
                            F.col("child_id").alias("category_id"),
                            F.col("child_name").alias("category_name")))
    g = rows.groupBy("root_id", "root_name").agg(F.array_sort(F.collect_list(child)).alias("kids"))
    return g.select(F.col("root_id").alias("category_id"), F.col("root_name").alias("category_name"),
                    F.transform("kids", lambda k: F.struct(k["category_id"].alias("category_id"),
                                                           k["category_name"].alias("category_name")))
                    .alias("children"))


def self_or_children(categories: DataFrame, category: int) -> DataFrame:
    """P-07: ids of the category and its direct children (not recursive)."""
    return categories.where((F.col("parent_id") == category) | (F.col("category_id") == category)) \
                     .select("category_id")


def filter_by_category(products: DataFrame, categories: DataFrame, category: int) -> DataFrame:
    """J-06: products whose category is ``category`` or one of its children.

    A semi-join replaces the source's collected IN-list.  When the lookup is
    empty the source falls back to plain equality; that fallback is a
    one-row global aggregate, so nothing is collected and no cross join is
    needed.
    """
    if category is None or category <= 0:
        return products
    if "parent_id" not in categories.columns:
        return products.where(F.col("category_id") == category)
    ids = self_or_children(categories, category)
    fallback = ids.agg(F.count(F.lit(1)).alias("n")).where("n = 0") \
                  .select(F.lit(category).cast("bigint").alias("category_id"))
    keys = ids.select(F.col("category_id").cast("bigint")).unionByName(fallback)
    return products.join(keys, "category_id", "left_semi")


def category_product_counts(products: DataFrame, categories: DataFrame) -> DataFrame:
    """J-06 for every category at once: products in the category or its children.

    Products are counted per category first (one row per category per task
    survives the map side, however skewed), then spread to (self, parent).
    """
    per_cat = products.groupBy("category_id").agg(F.count("product_id").alias("n"))
    links = categories.select(F.col("category_id").alias("target"), F.col("category_id")) \
        .unionByName(categories.where(F.col("parent_id").isNotNull())
                     .select(F.col("parent_id").alias("target"), F.col("category_id")))
    rolled = links.join(per_cat, "category_id").groupBy("target").agg(F.sum("n").alias("n"))
    return categories.select("category_id", "category_name").join(
        rolled.withColumnRenamed("target", "category_id"), "category_id", "left"
    ).select("category_id", "category_name",
             F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("product_count"))


def category_names(categories: DataFrame, roots_only: bool = False) -> DataFrame:
    """O-06: categories ordered by name (case-insensitively, id as tie-breaker)."""
    c = roots(categories, zero_is_root=False) if roots_only else categories
    return c.select("category_id", "category_name", "parent_id") \
            .orderBy(F.lower(F.col("category_name")), F.col("category_id"))


def add_children_by_parent_slug(categories: DataFrame, children: DataFrame) -> DataFrame:
    """S-03: append child categories whose ``parent_slug`` resolves to an existing category.

    All seed statements run as one join; an unknown slug adds nothing (the
    source's INSERT ... SELECT returns zero rows).  New ids continue after
    the current maximum: ``max + seq``, increasing, with gaps where a slug is
    unknown (``seq`` counts from 1; no task sees all rows).
    """
    parents = categories.select(F.col("category_slug").alias("parent_slug"),
                                F.col("category_id").alias("parent_id"))
    resolved = children.join(parents, "parent_slug")
    # max(category_id) as a scalar subquery: no collect, no join.
    base = categories.agg(F.coalesce(F.max("category_id"), F.lit(0)).cast("bigint")).scalar()
    new = resolved.withColumn("category_id", (base + F.col("seq")).cast("bigint"))
    cols = categories.columns
    return categories.unionByName(new.select(*[c if c in new.columns else F.lit(None).alias(c)
                                               for c in cols]), allowMissingColumns=True)
