"""Column dialects (S-06), the discount-column migration (S-07) and the
schema contract check (S-08).

Two schemas exist for the same tables: dialect 1 (prefixed keys such as
``product_id``, ``category_name``, ``discount_percent``) is canonical;
dialect 2 (bare ``id``, ``name``, ``discount``) is renamed once at load, so
no query branches on column names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# dialect-2 name -> canonical name, per table (fixed by the two schemas).
DIALECT2_TO_CANONICAL: dict[str, dict[str, str]] = {
    "products": {"id": "product_id", "discount": "discount_percent", "image": "image_path"},
    "businesses": {"id": "business_id", "name": "business_name", "phone": "business_phone",
                   "email": "business_email", "address": "address_line1", "zip": "postal_code"},
    "categories": {"id": "category_id", "name": "category_name"},
    "users": {"id": "user_id", "password": "password_hash", "user_role": "role"},
}

# Fixed values of the reference: the columns the product form needs.
PRODUCT_FORM_COLUMNS = ["business_id", "name", "description", "price", "discount", "category_id", "image"]


def resolve_columns(df: DataFrame, table: str) -> DataFrame:
    """S-06: rename dialect-2 columns to canonical names when the canonical one is absent."""
    renames = {old: new for old, new in DIALECT2_TO_CANONICAL.get(table, {}).items()
               if old in df.columns and new not in df.columns}
    return df.withColumnsRenamed(renames) if renames else df


def migrate_discount(products: DataFrame) -> DataFrame:
    """S-07 exactly as the setup script does it, producing the ``discount`` column.

    Both columns present: ``discount = discount_percent`` where
    ``discount = 0 AND discount_percent > 0`` (a NULL discount stays NULL),
    then ``discount_percent`` is dropped.  Only ``discount_percent``: rename.
    """
    cols = products.columns
    if "discount_percent" not in cols:
        return products
    if "discount" not in cols:
        return products.withColumnRenamed("discount_percent", "discount")
    cond = (F.col("discount") == 0) & (F.col("discount_percent") > 0)
    return products.withColumn(
        "discount", F.when(cond, F.col("discount_percent")).otherwise(F.col("discount"))
    ).drop("discount_percent")


def schema_contract(spark: SparkSession, tables: dict[str, DataFrame | None] | None = None,
                    required: dict[str, list[str]] | None = None) -> DataFrame:
    """S-08: one row (table_name, missing_column) per missing table or column.

    Tables not given in ``tables`` are looked up in the session catalog
    (``spark.catalog.tableExists``).  A missing table reports
    ``missing_column = NULL``.  Only schemas are read, never data.
    """
    required = required or {"products": PRODUCT_FORM_COLUMNS}
    tables = dict(tables or {})
    rows = []
    for table, cols in required.items():
        df = tables.get(table)
        if df is None and table not in tables and spark.catalog.tableExists(table):
            df = spark.table(table)
        if df is None:
            rows.append((table, None))
            continue
        present = set(df.columns)
        rows.extend((table, c) for c in cols if c not in present)
    return spark.createDataFrame(rows, "table_name string, missing_column string")
