"""Totals kept up to date by signed changes (C-09, A-03, A-04).

A rollup stores additive sums per key.  A batch of changes is a set of rows
with a sign: +1 for a row that appears, -1 for one that goes; a changed row is
its old form with -1 and its new form with +1.  Each batch is summed per key
(on the map side first) and appended under its batch id to a versioned table,
so a batch that runs again changes nothing, and only the batch is read.  The
totals are the sums over all batches; ``compact`` replaces them by one row for
each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souq.operators.reports import CLOSED_ITEM_STATUSES
from souq.operators.reviews import rated
from souq.sources.versions import VersionedTable


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows of changed ones: their old form and their new form."""
    return before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))


class Rollup:
    """Sums per key below ``path``; ``sums`` gives each total's expression over a row and its type."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: dict[str, tuple[Column, str]]) -> None:
        self.table = VersionedTable(spark, path)
        self.keys, self.sums = keys, sums

    def commit(self, rows: DataFrame, batch: str) -> int:
        """Apply signed rows (keys, ``sign``, what the sums read) once; a sign other than 1 and -1 is an error."""
        sign = F.when(F.col("sign").isin(1, -1), F.col("sign")).otherwise(
            F.raise_error(F.lit("a change's sign is 1 or -1"))).cast("int")
        r = rows.select(*self.keys, sign.alias("_sign"), *(e.alias(n) for n, (e, _) in self.sums.items()))
        d = r.groupBy(*self.keys).agg(
            F.sum("_sign").cast("bigint").alias("rows"),
            *(F.coalesce(F.sum(F.col("_sign") * F.col(n)), F.lit(0)).cast(t).alias(n) for n, (_, t) in self.sums.items()))
        return self.table.append(d, batch)

    def _total(self, version: int) -> DataFrame:
        return self.table.read(version).groupBy(*self.keys).agg(
            F.sum("rows").alias("rows"), *(F.sum(n).cast(t).alias(n) for n, (_, t) in self.sums.items()))

    def totals(self) -> DataFrame:
        """(keys, rows, sums) of every key that has rows."""
        return self._total(self.table.version()).where("rows <> 0")

    def compact(self) -> int:
        """Make one row of each key's changes; keys without rows go.  Batches stay known."""
        base = self.table.version()
        return self.table.replace(self._total(base).where("rows <> 0"), f"compaction of version {base}", base)


def rating_rollup(spark: SparkSession, path: str) -> Rollup:
    """A-03 + A-04 per product, of the reviews that are committed (leave hidden ones out, or take them out again)."""
    return Rollup(spark, path, ["product_id"], {
        "rating_sum": (F.coalesce("rating", F.lit(0)), "bigint"),
        "rated_count": (F.col("rating").isNotNull().cast("int"), "bigint")})


def ratings(rollup: Rollup, products: DataFrame) -> DataFrame:
    """A-03 + A-04 for every product, from the kept sums."""
    return rated(products, rollup.totals().withColumnRenamed("rows", "review_count"))


def sales_rollup(spark: SparkSession, path: str) -> Rollup:
    """C-09: units on live order lines per product."""
    live = F.when(F.col("status").isin(CLOSED_ITEM_STATUSES), 0).otherwise(F.col("quantity"))
    return Rollup(spark, path, ["product_id"], {"units": (live, "bigint")})


def total_sales(rollup: Rollup, products: DataFrame) -> DataFrame:
    """C-09 for every product, from the kept sums."""
    return products.select("product_id").join(rollup.totals().select("product_id", "units"), "product_id", "left") \
                   .select("product_id", F.coalesce("units", F.lit(0).cast("bigint")).alias("total_sales"))
