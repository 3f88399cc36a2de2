"""Product ratings (A-03, A-04).

The source asks once per product (``AVG(rating)``, ``COUNT(*)``); here all
products are rated in one aggregation.  Reviews are grouped before meeting
products: partial aggregation turns a product with millions of reviews into
one row per task before the shuffle.

MySQL's ``AVG`` of an integer column is a decimal with 4 more digits
(rounded half up) that PHP then rounds to one digit (T-06).  Both steps are
done in exact integer arithmetic (``div``), so no binary floating point is
involved and any engine gives the same digits.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

RATING = DecimalType(4, 1)


def rating_stats(reviews: DataFrame, exclude_hidden: bool = False) -> DataFrame:
    """(product_id, rating_sum, review_count, rated_count) per reviewed product."""
    r = reviews.where(~F.coalesce(F.col("is_hidden"), F.lit(False))) if exclude_hidden else reviews
    return r.groupBy("product_id").agg(
        F.sum("rating").cast("bigint").alias("rating_sum"),
        F.count(F.lit(1)).alias("review_count"),
        F.count("rating").alias("rated_count"))


def with_mean_rating(stats: DataFrame) -> DataFrame:
    """Add ``avg_rating`` = round(round(sum/n, 4), 1), half up, decimal(4,1); NULL if n = 0."""
    avg4 = F.expr("CASE WHEN rated_count > 0 THEN "
                  "(rating_sum * 20000 + rated_count) div (rated_count * 2) END")
    tenths = F.expr("(_avg4 + 500) div 1000")
    return stats.withColumn("_avg4", avg4) \
                .withColumn("avg_rating", (tenths.cast(DecimalType(18, 0)) * F.lit(Decimal("0.1")))
                            .cast(RATING)) \
                .drop("_avg4")


def product_ratings(products: DataFrame, reviews: DataFrame, exclude_hidden: bool = False) -> DataFrame:
    """A-03 + A-04 for every product: (product_id, avg_rating, review_count).

    Products without reviews get 0.0 and 0.  Hidden reviews count unless
    ``exclude_hidden`` (the source does not exclude them).
    """
    return rated(products, rating_stats(reviews, exclude_hidden))


def rated(products: DataFrame, stats: DataFrame) -> DataFrame:
    """The ratings of every product from (product_id, rating_sum, review_count, rated_count)."""
    j = products.select("product_id").join(with_mean_rating(stats), "product_id", "left")
    return j.select("product_id",
                    F.coalesce("avg_rating", F.lit(Decimal("0.0")).cast(RATING)).alias("avg_rating"),
                    F.coalesce("review_count", F.lit(0).cast("bigint")).alias("review_count"))
