"""Shared helpers: scratch tables, word hashing on Arrow buffers, components.

A *word* is a maximal run of bytes other than space and 0x09-0x0D; a null text
has none.  Word hashes are 64-bit values computed on whole Arrow batches with
numpy, in pieces of about a megabyte so that memory stays bounded however long
a batch is (a single longer text is one piece).
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souq.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15          # odd, hence invertible modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


# ---------------------------------------------------------------- tables

def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return scratch_path(spark, f"souq-llm/{name}-{uuid.uuid4().hex}")


def write_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``folder`` and return it reread.

    Cuts lineage on shared storage (a lost executor costs no recomputation),
    and gives the optimizer the table's true size for its join choice.
    """
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, folder: str, name: str) -> None:
    """Delete a table of ``write_table`` that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have shuffle files of finished steps deleted: Spark does so when the driver collects what refers to them.

    The first round lets go of what Python held, which the JVM hears a moment later; the second collects it.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name, i = f"_{stem}", 0
    while name.lower() in taken:
        i += 1
        name = f"_{stem}{i}"
    return name


def null_safe(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


# ---------------------------------------------------------------- words

def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * PIECE_BYTES:           # keep the usual size only
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finalize 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def utf8_view(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, off


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of every row (plus the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = np.empty(len(data), dtype=bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.empty(len(data), dtype=bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(solid & first)
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[s:e] for every span; equal bytes give equal hashes."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _pow(_BASE, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _pow(_INV, n + 1)[starts])


def hashed_words(column, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of an Arrow string column as (first row, word hashes, row offsets into them)."""
    data, off = utf8_view(column)
    for lo, hi in pieces(off):
        part = data[off[lo]:off[hi]]
        if lower:
            part = _LOWER[part]
        starts, ends, rows = word_bounds(part, off[lo:hi + 1] - off[lo])
        yield lo, span_hashes(part, starts, ends), rows


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- components

def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, comp), comp the smallest node.

    Alternating large-star and small-star steps, each a grouped minimum and a
    join back on the same key, written to shared storage.  The number of steps
    grows with the logarithm of the graph; edges stay in Spark throughout.
    Only nodes that have an edge appear.
    """
    e = write_table(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}-0")

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    seen, step = state(e), 0
    while seen[0]:
        step += 1
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = e.where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = (e.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
            .where("a <> b").distinct())
        e = write_table(e, folder, f"{name}-{step}")
        now = state(e)
        if now == seen:
            break
        seen = now
    low = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return low.union(e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
