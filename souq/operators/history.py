"""Order history as rows, from a layout that keeps each customer's orders together (C-05).

The orders are stored once, bucketed and sorted by customer.  Reading the
history of all customers, or a page of it, then needs no shuffle: a task reads
whole buckets and passes each customer's orders in order, however many there
are, without gathering them.  One customer's history reads one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def store_history(orders: DataFrame, order_items: DataFrame, table: str, path: str, buckets: int | None = None) -> DataFrame:
    """Write the layout as the (external) table ``table`` and return it: one row per order with its lines and units."""
    spark = orders.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = order_items.groupBy("order_id").agg(F.count(F.lit(1)).alias("order_lines"),
                                                F.sum("quantity").cast("bigint").alias("units"))
    zero = F.lit(0).cast("bigint")
    rows = orders.join(lines, "order_id", "left").select(
        "user_id", "order_id", "created_at", "order_status", "payment_status", "total_amount",
        F.coalesce("order_lines", zero).alias("order_lines"), F.coalesce("units", zero).alias("units"))
    (rows.repartition(n, "user_id").sortWithinPartitions("user_id", F.desc("created_at"), "order_id")
     .write.mode("overwrite").bucketBy(n, "user_id").sortBy("user_id").option("path", path).saveAsTable(table))
    return stored_history(spark, table)


def stored_history(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def order_pages(history: DataFrame, page: int | None = None, page_size: int = 10) -> DataFrame:
    """Orders newest first, numbered per customer; with ``page``, that page of every customer."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.asc("order_id"))
    rows = history.withColumn("position", F.row_number().over(w).cast("bigint"))
    if page is None:
        return rows
    lo = (max(1, page) - 1) * page_size
    return rows.where((F.col("position") > lo) & (F.col("position") <= lo + page_size))
