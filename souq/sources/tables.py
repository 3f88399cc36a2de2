"""S-01: table scan by name."""

from __future__ import annotations

import os

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Columns of tables read before, by path and time of change: a footer is read once, files are listed every time.
_columns: dict[tuple[str, int], StructType] = {}


def _changed(spark: SparkSession, path: str) -> int | None:
    """When the file or folder last changed; None where the file system cannot be asked."""
    try:
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()
    except (Py4JError, PySparkException):              # absent, or Spark Connect
        return None


def scan(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Read ``{base}/{table}.parquet`` (a file or a folder of part files).

    Parquet keeps column pruning and filter pushdown: only the columns and
    row groups a plan needs are read.
    """
    path = os.path.join(base, f"{table}.parquet")
    changed = _changed(spark, path)
    columns = _columns.get((path, changed)) if changed is not None else None
    if columns is not None:
        return spark.read.schema(columns).parquet(path)
    df = spark.read.parquet(path)
    if changed is not None:
        _columns[path, changed] = df.schema
    return df


def scan_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
              properties: dict | None = None) -> DataFrame:
    """Optional second source: a relational table over JDBC.

    With ``partition_column`` the read is split into ``num_partitions``
    parallel range queries instead of one single-task scan.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper)
                  .option("numPartitions", num_partitions))
    return reader.load()
