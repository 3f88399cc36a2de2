"""Intake batches derived from the driver tables.

Each part becomes a product-form submission and each customer a
registration, with deterministic defects (empty names, bad numbers, large
or wrong images, reused emails, short passwords ...) chosen by key residues.
The same derivation is written in SQL in ``souq.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souq.functions.text import slugify
from souq.sources.views import MarketViews


def product_candidates(v: MarketViews) -> DataFrame:
    p = v.raw("part")
    d = v.raw("documents").select(F.col("doc_id").alias("p_partkey"), F.col("text"))
    k = F.col("p_partkey")
    return p.join(d, "p_partkey", "left").select(
        k.alias("arrival_no"),
        (k % 100).alias("business_id"),
        F.when(k % 11 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("name"),
        F.col("text").alias("description"),
        F.when(k % 13 == 0, F.concat(F.lit("x"), F.col("p_brand")))
         .otherwise(F.substring("p_brand", 7, 10)).alias("category"),
        F.concat(F.when(k % 17 == 0, F.lit("-")).otherwise(F.lit("")),
                 F.col("p_size").cast("string"), F.lit("."), (k % 100).cast("string"),
                 F.when(k % 4 == 0, F.lit("usd")).otherwise(F.lit(""))).alias("price"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise((F.col("p_size") * 3).cast("string")).alias("discount"),
        F.when(k % 19 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lower("p_type"), F.lit(" "), k.cast("string"), F.lit(".jpg"))).alias("image_name"),
        F.when(k % 7 == 0, F.lit("image/gif")).otherwise(F.lit("image/jpeg")).alias("image_type"),
        (F.col("p_size") * 120000).cast("bigint").alias("image_size"),
    )


def user_candidates(v: MarketViews) -> DataFrame:
    c = v.raw("customer")
    k = F.col("c_custkey")
    password = F.when(k % 11 == 0, F.lit("short")).otherwise(F.concat(F.lit("pw"), F.lpad(k.cast("string"), 8, "0")))
    return c.select(
        k.alias("arrival_no"),
        F.when(k % 23 == 0, F.lit("")).otherwise(F.col("c_name")).alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
        F.when(k % 3 == 0, F.upper(F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com "))))
         .when(k % 3 == 1, F.concat(F.lit("new"), (k % 500).cast("string"), F.lit("@Example.com")))
         .otherwise(F.concat(F.lit("bad-email-"), k.cast("string"))).alias("email"),
        F.when(k % 7 == 0, F.concat(F.lit("555-"), k.cast("string")))
         .otherwise((F.lit(5550000) + k).cast("string")).alias("phone"),
        password.alias("password"),
        F.when(k % 13 == 0, F.lit("mismatch!")).otherwise(password).alias("confirm_password"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("business")).otherwise(F.lit("customer"))
         .alias("registration_type"),
    )


def namesake_users(v: MarketViews) -> tuple[DataFrame, DataFrame]:
    """(accepted registrations, user table) in which a third share one name and the table holds many of its numbers."""
    k = F.col("user_id")
    u = v.users
    first = F.when(k % 3 == 0, F.when(k % 2 == 0, "Ann").otherwise("ANN")).otherwise(F.col("last_name"))
    last = F.when(k % 3 == 0, "Lee").when(k % 5 == 0, F.lit("Route 66")).otherwise(F.col("last_name"))
    batch = u.select(k.alias("arrival_no"), first.alias("first_name"), last.alias("last_name"), "email")
    name = F.when(k % 2 == 0, F.concat(F.lit("ann.lee"), (100 + k % 1300).cast("string"))) \
            .when(k % 7 == 0, F.concat(F.upper("last_name"), F.lit("."), F.col("last_name"), (100 + k % 50).cast("string"))) \
            .when(k % 11 == 0, F.concat(F.lit("automobile.route 66."), (90 + k % 30).cast("string"))) \
            .otherwise(F.col("username"))
    return batch, u.withColumn("username", name)


def namesake_products(v: MarketViews) -> tuple[DataFrame, DataFrame]:
    """(new products, product table with slugs): one name for a third of all, some without a usable letter."""
    k = F.col("product_id")
    p = v.products.select("product_id", F.when(k % 17 == 0, F.lit(" !!! ")).when(k % 3 == 0, F.lit("Hot Item"))
                          .otherwise(F.col("name")).alias("name"))
    table = p.where(k % 4 == 0).select("product_id", F.concat(
        slugify("name"), F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("-"), (2 + k % 40).cast("string")))).alias("slug"))
    return p.where(k % 4 != 0).withColumnRenamed("product_id", "arrival_no"), table


def _break(df: DataFrame, **cols) -> DataFrame:
    """``df`` with some values replaced: column=(condition, broken value)."""
    return df.withColumns({c: F.when(F.expr(cond), F.expr(bad)).otherwise(F.col(c))
                           for c, (cond, bad) in cols.items()})


def defective_tables(v: MarketViews, names: list[str]) -> dict[str, DataFrame]:
    """The marketplace tables with values broken by key residue, so that every audit has something to find."""
    t = {n: v.table(n) for n in names}
    broken = {
        "users": dict(first_name=("user_id % 41 = 0", "NULL"), role=("user_id % 50 = 0", "'guest'"),
                      last_name=("user_id % 47 = 0", "repeat('x', 60)"),
                      email=("user_id % 53 = 0", "'SHARED' || (user_id % 3) || '@Example.com '")),
        "businesses": dict(city=("business_id % 3 = 0", "NULL"), status=("business_id % 4 = 0", "'closed'"),
                           business_name=("business_id % 5 = 0", "repeat('b', 101)"),
                           user_id=("business_id % 7 = 0", "-business_id")),
        "products": dict(name=("product_id % 37 = 0", "NULL"),
                         price=("product_id % 31 = 0", "CAST(123456789012 AS DECIMAL(14,2))"),
                         category_id=("product_id % 29 = 0", "9000 + product_id % 4"),
                         slug=("product_id % 23 = 0", "'same'")),
        "categories": dict(parent_id=("category_id = 101", "77"), category_slug=("category_id = 102", "NULL")),
        "product_images": dict(image_path=("image_id % 11 = 0", "repeat('p', 300)")),
        "product_reviews": dict(rating=("review_id % 59 = 0", "NULL"),
                                product_id=("review_id % 61 = 0", "-1 - review_id % 5")),
        "orders": dict(order_status=("order_id % 67 = 0", "'lost'"), payment_status=("order_id % 71 = 0", "'void'"),
                       total_amount=("order_id % 73 = 0", "NULL"), user_id=("order_id % 79 = 0", "-user_id")),
        "order_items": dict(status=("order_id % 83 = 0", "'gone'"),
                            price=("order_id % 89 = 0", "CAST(9999999999 AS DECIMAL(12,2))"),
                            order_id=("order_id % 97 = 0", "-order_id")),
        "forum_topics": dict(title=("topic_id % 6 = 0", "repeat('t', 256)"), slug=("topic_id % 7 = 0", "'topic'")),
        "forum_posts": dict(content=("topic_id % 8 = 0", "NULL"), topic_id=("topic_id % 9 = 0", "-topic_id")),
    }
    return {n: _break(df, **broken[n]) if n in broken else df for n, df in t.items()}
