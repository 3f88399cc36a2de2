"""Surrogate keys and plain appends (S-02, S-04, S-05).

Parquet files are immutable, so an INSERT becomes an append of new part files.
A plain append that runs again adds its rows again, and an overwritten folder
is empty while it is written: tables that jobs change are ``versions.VersionedTable``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign_keys(new_rows: DataFrame, existing: DataFrame, key: str, arrival: str = "arrival_no") -> DataFrame:
    """Surrogate keys for appended rows: ``max(existing key) + arrival number``.

    Like AUTO_INCREMENT the keys are unique and increase with arrival, with
    gaps where candidates were rejected.  No global window or single-task
    numbering is needed: ``arrival`` is unique within a batch and the base is
    a scalar subquery.
    """
    base = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).scalar()
    return new_rows.withColumn(key, (base + F.col(arrival)).cast("bigint"))


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write a complete table into a folder that does not exist yet."""
    df.write.mode("errorifexists").format("parquet").save(path)
