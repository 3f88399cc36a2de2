"""Ranks, running totals and free numbers within a key, by many tasks for one key.

A window over a key alone brings all rows of that key into one task.  Here
every key is cut into blocks of ``block`` consecutive values of the ordering
integer: what a block needs from the blocks before it is a sum over one row per
block (counted on the map side), and only the rows of one block meet in a task.
A key that holds a third of all rows is then numbered by as many tasks as it
has blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of the ordering integer in a block, and so the most rows of a key that meet in a task.
BLOCK = 1 << 16


def _with_block(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))


def _before(sums: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """(keys, _block, _before): the total of the blocks before each."""
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "_block", F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("bigint").alias("_before"))


def ranked(df: DataFrame, keys: list[str], order: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``out``: the rank (from 1) of the integer ``order`` within ``keys``.

    ``order`` is unique within a key; keys and ``order`` are not null.
    """
    d = _with_block(df, order, block)
    counts = d.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    own = d.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)))
    out_rows = own.join(_before(counts, keys, "_rows"), [*keys, "_block"])
    return out_rows.withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", "_block")


def running_total(df: DataFrame, keys: list[str], order: str, tie: str, amount: str, out: str,
                  block: int = BLOCK) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` up to and with each row, by (``order``, ``tie``) within ``keys``."""
    d = _with_block(df, order, block)
    sums = d.groupBy(*keys, "_block").agg(F.sum(amount).alias("_total"))
    w = Window.partitionBy(*keys, "_block").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    own = d.withColumn("_own", F.sum(amount).over(w))
    out_rows = own.join(_before(sums, keys, "_total"), [*keys, "_block"])
    return out_rows.withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before", "_block")


def free_numbers(wanted: DataFrame, used: DataFrame, keys: list[str], first: int, arrival: str = "arrival_no",
                 block: int = BLOCK) -> DataFrame:
    """``wanted`` (keys, arrival) with ``number``: by arrival, the smallest integers from ``first`` on that ``used``
    (keys, number) does not hold.

    A used number with i - 1 used ones below it has ``number - first - (i - 1)`` free ones below.  The n-th free
    number lies beyond exactly the used numbers that have fewer than n free ones below, so it is ``first - 1 + n``
    and how many those are: one running total over used numbers and ranks, no list of free numbers.
    """
    taken = used.where(F.col("number") >= first).select(*keys, F.col("number").cast("bigint").alias("number")).distinct()
    taken = taken.join(wanted.select(*keys).distinct(), keys, "left_semi")
    gaps = ranked(taken, keys, "number", "_i", block)
    gaps = gaps.groupBy(*keys, (F.col("number") - first - F.col("_i") + 2).alias("_at")).agg(
        F.count(F.lit(1)).alias("_used"))
    asks = ranked(wanted.select(*keys, arrival), keys, arrival, "_at", block)
    rows = asks.select(*keys, arrival, F.col("_at").cast("bigint").alias("_at"), F.lit(0).cast("bigint").alias("_used"),
                       F.lit(1).alias("_tie"))
    rows = rows.unionByName(gaps.select(*keys, F.lit(None).cast(rows.schema[arrival].dataType).alias(arrival),
                                        F.col("_at").cast("bigint").alias("_at"), "_used", F.lit(0).alias("_tie")))
    total = running_total(rows, keys, "_at", "_tie", "_used", "_passed", block).where("_tie = 1")
    return total.select(*keys, arrival, (F.col("_at") + F.col("_passed") + (first - 1)).alias("number"))
