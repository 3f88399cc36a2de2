"""Any page of any seller's catalog without the rows before it (O-05, A-02, A-05).

``OFFSET n LIMIT k`` keeps n + k rows in every task and in the driver.  Here the
products are stored in page order (seller, newest first, id), cut into parts by
range, so that a large seller fills many parts, and an index row for every
(seller, part) holds how many of the seller's rows the part has and how many
come before it:

    <path>/rows     the products, stored by part
    <path>/index    part, business_id, rows, before
    <path>/columns  no rows; the products' columns, also of an empty catalog

A page is looked up in the index (at most one row more than the page has), and
only the parts that hold it are read.  The count of a seller is the sum of its
index rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from souq.operators.catalog import PAGE_SIZE, page_offset


def _order() -> list:
    return [F.desc("created_at"), F.asc("product_id")]


class RankIndex:
    """Products below ``path`` in page order."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def build(self, products: DataFrame, parts: int | None = None) -> RankIndex:
        """Store the products; ``parts`` is a number of files to aim for (the session's shuffle partitions)."""
        by = ["business_id", *_order()]
        products.where("false").write.parquet(f"{self.path}/columns")
        n = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (products.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
         .write.partitionBy("part").parquet(f"{self.path}/rows"))
        counts = self.rows.groupBy("part", "business_id").agg(F.count(F.lit(1)).alias("rows"))
        w = Window.partitionBy("business_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        (counts.withColumn("before", F.coalesce(F.sum("rows").over(w), F.lit(0).cast("bigint")))
         .repartitionByRange("business_id", "part").sortWithinPartitions("business_id", "part")
         .write.parquet(f"{self.path}/index"))
        return self

    @property
    def rows(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}/columns").schema
        return self.spark.read.schema(columns.add("part", IntegerType())).parquet(f"{self.path}/rows")

    @property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def counts(self, page_size: int = PAGE_SIZE) -> DataFrame:
        """A-02 + A-05: (business_id, total_products, total_pages) of every seller that has products."""
        return self.index.groupBy("business_id").agg(F.sum("rows").alias("total_products")).withColumn(
            "total_pages", F.ceil(F.col("total_products") / F.lit(page_size)).cast("bigint"))

    def page(self, business_id: int, page: int | None = 1, page_size: int = PAGE_SIZE) -> DataFrame:
        """O-05: the rows of one page; empty beyond the last one."""
        lo = page_offset(page, page_size)
        held = self.index.where((F.col("business_id") == business_id) & (F.col("before") < lo + page_size)
                                & (F.col("before") + F.col("rows") > lo)).collect()
        before = {r.part: r.before for r in held}
        rows = self.rows.where(F.col("part").isin(list(before)) & (F.col("business_id") == business_id))
        if not before:
            return rows.where("false").drop("part")
        base = F.element_at(F.create_map(*(F.lit(x) for p in before.items() for x in p)), F.col("part"))
        rank = F.row_number().over(Window.partitionBy("part").orderBy(*_order())) + base
        return rows.withColumn("_rank", rank).where((F.col("_rank") > lo) & (F.col("_rank") <= lo + page_size)) \
                   .drop("_rank", "part").orderBy(*_order())
