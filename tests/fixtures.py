"""Small hand-written marketplace tables with the edge cases of FIXTURES.md."""

from datetime import datetime as dt
from decimal import Decimal as D

T0 = dt(2024, 1, 1, 12, 0, 0)

BUSINESSES = [  # business_id, user_id, business_name, business_slug, city, state, status, created_at
    (1, 10, "Alpha", "alpha", "Pune", "MH", "active", dt(2024, 1, 1)),
    (2, 20, "Beta", "beta", "Delhi", None, "active", dt(2024, 1, 3)),
    (3, 30, "Gamma", "gamma", None, None, "pending", dt(2024, 1, 3)),     # no products; ties Beta
    (4, 40, "Delta", "delta", "Goa", "GA", "suspended", dt(2023, 12, 1)),
]
B_SCHEMA = ("business_id long, user_id long, business_name string, business_slug string, city string, "
            "state string, status string, created_at timestamp_ntz")

PRODUCTS = [  # product_id, business_id, category_id, name, slug, description, price, discount, created_at
    (1, 1, 11, "Red Phone", "red-phone", "A red phone", D("100.00"), D("10.00"), dt(2024, 2, 1)),
    (2, 1, 11, "Blue Phone", "blue-phone", None, D("200.00"), D("0.00"), dt(2024, 2, 2)),
    (3, 2, 12, "Red Shirt", "red-shirt", "cotton 100%", D("19.99"), D("12.50"), dt(2024, 2, 2)),
    (4, 2, 2, "Bread", "bread", "fresh_bread", D("2.50"), None, dt(2024, 2, 3)),
    (5, 9, 11, "Orphan", "orphan", "no business", D("5.00"), D("50.00"), dt(2024, 3, 1)),   # orphan
    (6, 1, 99, "Mystery", "mystery", "unknown category", D("1.01"), D("12.50"), dt(2024, 2, 2)),
]
P_SCHEMA = ("product_id long, business_id long, category_id long, name string, slug string, "
            "description string, price decimal(10,2), discount_percent decimal(5,2), created_at timestamp_ntz")

IMAGES = [  # image_id, product_id, image_path, is_primary, display_order
    (1, 1, "p1-a.jpg", True, 2),
    (2, 1, "p1-b.jpg", True, 1),      # two primaries: lowest display_order wins
    (3, 2, "p2-x.jpg", False, 0),     # only non-primary: no card image
    (4, 3, "p3.jpg", True, 0),
]
I_SCHEMA = "image_id long, product_id long, image_path string, is_primary boolean, display_order int"

CATEGORIES = [  # category_id, category_name, category_slug, parent_id
    (1, "Electronics", "electronics", None),
    (2, "Grocery", "grocery", 0),            # root by the parent_id = 0 rule
    (3, "Empty", "empty", None),             # root without children
    (11, "phones", "phones", 1),
    (12, "Apparel", "apparel", 1),
    (21, "Bakery", "bakery", 2),
]
C_SCHEMA = "category_id long, category_name string, category_slug string, parent_id long"


def tables(spark):
    return {
        "businesses": spark.createDataFrame(BUSINESSES, B_SCHEMA),
        "products": spark.createDataFrame(PRODUCTS, P_SCHEMA),
        "product_images": spark.createDataFrame(IMAGES, I_SCHEMA),
        "categories": spark.createDataFrame(CATEGORIES, C_SCHEMA),
    }
