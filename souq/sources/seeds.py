"""Seed rows (S-02) as DataFrames.

Fixed values of the reference, in its order: the nine root categories and
the nine children of the install script (children name their parent by
slug), the ten flat categories of the second dialect, and the example
accounts.  Password hashes are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Root categories (name, slug, description, icon, display_order).
ROOT_CATEGORIES = [
    ("All Categories", "all", "Browse all products across categories", "bi-grid-fill", 1),
    ("Grocery", "grocery", "Fresh foods, pantry items, and household essentials", "bi-basket-fill", 2),
    ("Electronics", "electronics", "Computers, mobile phones, TVs, and other gadgets", "bi-laptop-fill", 3),
    ("Fashion", "fashion", "Clothing, shoes, and accessories for all ages", "bi-bag-fill", 4),
    ("Home", "home", "Furniture, decor, and home improvement products", "bi-house-fill", 5),
    ("Appliances", "appliances", "Kitchen and home appliances for modern living", "bi-tv-fill", 6),
    ("Beauty", "beauty", "Makeup, skincare, and personal care products", "bi-stars", 7),
    ("Toys", "toys", "Toys, games, and entertainment for children", "bi-controller", 8),
    ("Community", "community", "Products and services from your local community", "bi-people-fill", 9),
]

# Child categories (name, slug, description, icon, parent slug, display_order).
CHILD_CATEGORIES = [
    ("Smartphones", "smartphones", "Mobile phones and accessories", "bi-phone-fill", "electronics", 1),
    ("Laptops", "laptops", "Laptops and accessories", "bi-laptop-fill", "electronics", 2),
    ("Audio", "audio", "Headphones, speakers and audio equipment", "bi-headphones", "electronics", 3),
    ("Men", "mens-fashion", "Clothing, footwear and accessories for men", "bi-person-fill", "fashion", 1),
    ("Women", "womens-fashion", "Clothing, footwear and accessories for women", "bi-person-fill", "fashion", 2),
    ("Kids", "kids-fashion", "Clothing, footwear and accessories for children", "bi-person-fill", "fashion", 3),
    ("Fresh Produce", "fresh-produce", "Fresh fruits and vegetables", "bi-basket2-fill", "grocery", 1),
    ("Bakery", "bakery", "Fresh breads, pastries and baked goods", "bi-basket2-fill", "grocery", 2),
    ("Dairy", "dairy", "Milk, cheese and other dairy products", "bi-basket2-fill", "grocery", 3),
]

# Flat category names of the second dialect.
FLAT_CATEGORIES = ["Electronics", "Clothing", "Home & Kitchen", "Books", "Toys & Games",
                   "Beauty & Personal Care", "Sports & Outdoors", "Grocery", "Health", "Automotive"]

# Example accounts (username, first, last, email, phone, role, is_verified).
# The mail domain of the demo accounts is ours (no result depends on it).
EXAMPLE_EMAIL_DOMAIN = "example.com"
EXAMPLE_USERS = [
    ("admin", "Admin", "User", f"admin@{EXAMPLE_EMAIL_DOMAIN}", "1234567890", "admin", True),
    ("business", "Business", "Owner", f"business@{EXAMPLE_EMAIL_DOMAIN}", None, "business_owner", True),
]

# The example business created for a new example seller
# (name, email, phone, address, city, state, zip, description).
EXAMPLE_BUSINESS = ("Local Store", f"business@{EXAMPLE_EMAIL_DOMAIN}", "1234567890", "123 Main St",
                    "Cityville", "State", "12345", "An example local business")

CATEGORY_SCHEMA = ("category_id bigint, category_name string, category_slug string, "
                   "category_description string, category_icon string, parent_id bigint, "
                   "is_active boolean, display_order int")


def root_categories(spark: SparkSession) -> DataFrame:
    """The nine roots with ids 1..9 in insert order (AUTO_INCREMENT on an empty table)."""
    rows = [(i + 1, n, s, d, ic, None, True, o) for i, (n, s, d, ic, o) in enumerate(ROOT_CATEGORIES)]
    return spark.createDataFrame(rows, CATEGORY_SCHEMA)


def child_category_seed(spark: SparkSession) -> DataFrame:
    """Children with their parent slug and statement order ``seq`` (for S-03)."""
    rows = [(n, s, d, ic, p, o, i + 1) for i, (n, s, d, ic, p, o) in enumerate(CHILD_CATEGORIES)]
    return spark.createDataFrame(rows, "category_name string, category_slug string, "
                                       "category_description string, category_icon string, "
                                       "parent_slug string, display_order int, seq int")


def flat_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(FLAT_CATEGORIES)], "id bigint, name string")


def example_users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLE_USERS, "username string, first_name string, last_name string, "
                                                "email string, phone string, role string, is_verified boolean")


def missing_example_accounts(spark: SparkSession, users: DataFrame,
                             businesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-02 + P-09: example accounts to append, only for roles nobody has yet.

    Returns (users_to_add, businesses_to_add): the admin if no admin exists,
    the example seller if no business owner exists, and the example business
    for a seller created here.  Role presence is an anti-join, nothing is
    collected; new keys continue after the current maxima.
    """
    from souq.sources.sinks import assign_keys
    seed = example_users(spark).withColumn(
        "arrival_no", F.when(F.col("role") == "admin", 1).otherwise(2).cast("bigint"))
    present = users.select("role").where(F.col("role").isin("admin", "business_owner"))
    add = assign_keys(seed.join(present, "role", "left_anti"), users, "user_id").drop("arrival_no")
    name, email, phone, addr, city, state, zip_code, desc = EXAMPLE_BUSINESS
    biz = add.where(F.col("role") == "business_owner").select(
        "user_id", F.lit(name).alias("business_name"), F.lit(email).alias("business_email"),
        F.lit(phone).alias("business_phone"), F.lit(addr).alias("address_line1"),
        F.lit(city).alias("city"), F.lit(state).alias("state"), F.lit(zip_code).alias("postal_code"),
        F.lit(desc).alias("description"), F.lit(1).cast("bigint").alias("arrival_no"))
    biz = assign_keys(biz, businesses, "business_id").drop("arrival_no")
    return add, biz
