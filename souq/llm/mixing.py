"""Mixing sources to target weights with hash-threshold histograms, built-in functions only.

Every row has a 60-bit hash of its key.  A source whose target is r times its
size takes each row floor(r) times, and the rows whose hash is at most a
threshold once more.  Thresholds come from histograms: words are summed by
source and hash bucket, a running sum over the (at most 4096) buckets finds
the bucket where the budget is crossed, and only that bucket is split again by
the next 12 bits, five levels deep, until a single hash value remains.  No
row is sorted, and none leaves Spark; thresholds are nested (a smaller budget
takes a subset of a larger one's rows).

Rows whose key is equal share a hash and are taken together.  Null text has
size 0; a null source is a source of its own, last in order.  A null key
hashes as the empty string with a mark of its own.  An empty table gives no
rows.  Other columns are neither read nor kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souq.llm.common import WORD, fresh_name, null_safe, work_folder, write_table

WEIGHTS = (1, 2, 3)
CAP = 3
BITS, LEVELS = 12, 5                 # 4096 buckets a level, 60 bits in all


def key_hash(key: str) -> Column:
    """60 bits of the md5 of the key as text; equal keys have equal hashes, null has one of its own."""
    k = F.col(f"`{key}`").cast("string")
    digest = F.md5(F.coalesce(F.concat(F.lit("="), k), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("bigint")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, hash): the words of every row's whole text, and its 60-bit hash."""
    return docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        key_hash(key).alias("hash"))


def source_targets(sized: DataFrame, folder: str, weights=WEIGHTS, budget: float = 1.0, cap: int = CAP) -> DataFrame:
    """(source, source_size, target), the budget shared by weight below ``cap`` times a source's size.

    Sources rank by code point, null last: a range partitioning by name, a
    row number inside each partition, and the partitions' offsets give the
    global rank without one task seeing every source.  The water level
    (words per unit of weight) is found by resharing the excess of capped
    sources until none is above its cap; each round is one sum.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    per = write_table(per.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), folder, "sources")
    start = per.groupBy("part").agg(F.count("*").alias("n"))
    start = start.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("rank") % len(weights)) + 1).cast("int"))
    per = per.withColumn("local", rank).join(start, "part").withColumn("rank", F.col("local") + F.col("start"))
    per = write_table(per.select("source", "source_size", w.cast("bigint").alias("weight")), folder, "weights")
    total = float((per.agg(F.sum("source_size")).first()[0] or 0) * budget)
    level, before = 0.0, None
    while True:
        over = F.col("weight") * F.lit(level) > cap * F.col("source_size")
        capped, held, free = per.agg(F.sum(over.cast("int")), F.sum(F.when(over, cap * F.col("source_size"))),
                                     F.sum(F.when(~over, F.col("weight")))).first()
        if capped == before or not free:
            break
        level, before = (total - (held or 0)) / free, capped
    target = F.least((F.col("weight") * F.lit(level)).cast("double"), (cap * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("hash", BITS * (LEVELS - 1 - level)).bitwiseAND(F.lit((1 << BITS) - 1))


def _crossing(rows: DataFrame, state: DataFrame, folder: str, tag: str) -> DataFrame:
    """(source, threshold, left) for ``state(source, left)``.

    ``threshold`` is the largest hash up to which the running sum of ``size``
    over ``rows(source, size, hash)`` stays within ``left`` (-1: none, the
    largest hash: all); ``left`` becomes what the budget has over.
    """
    s = state.select("source", "left", F.lit(0).cast("bigint").alias("prefix"), F.lit(False).alias("done"))
    s = write_table(s, folder, f"{tag}-0")
    for level in range(LEVELS):
        open_ = s.where("not done").select(F.col("source").alias("s"), "prefix", "left")
        inside = rows if level == 0 else rows.join(
            open_.select("s", "prefix"), null_safe(F.col("source"), F.col("s"))
            & (F.shiftright("hash", BITS * (LEVELS - level)) == F.col("prefix")), "left_semi")
        hist = inside.groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("words").over(upto))
        # per source: the bucket that crosses the budget, and all words of the prefix
        cross = hist.join(open_, null_safe(F.col("source"), F.col("s"))).groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "upto", "words"))).alias("c"),
            F.max("upto").alias("sum"))
        nxt = s.join(cross.select(F.col("source").alias("s"), "c", "sum"),
                     null_safe(F.col("source"), F.col("s")), "left")
        hit, last = F.col("c").isNotNull(), level == LEVELS - 1
        width = BITS * (LEVELS - level)
        whole = F.shiftleft("prefix", width) + F.lit((1 << width) - 1)       # all of the prefix fits
        within = F.shiftleft("prefix", BITS) + F.col("c.bucket") - (1 if last else 0)
        used = F.when(hit, F.col("c.upto") - F.col("c.words")).otherwise(F.coalesce("sum", F.lit(0)))
        s = write_table(nxt.select(
            "source", F.when(F.col("done"), F.col("left")).otherwise(F.col("left") - used).alias("left"),
            F.when(F.col("done"), F.col("prefix")).when(hit, within).otherwise(whole).alias("prefix"),
            (F.col("done") | ~hit | F.lit(last)).alias("done")), folder, f"{tag}-{level + 1}")
    return s.select("source", F.col("prefix").alias("threshold"), "left")


def thresholds(sized: DataFrame, targets: DataFrame, folder: str) -> DataFrame:
    """(source, source_size, target, copies, t1, room, t2).

    A row gets ``copies`` copies, and one more if hash <= t1, or if its size
    is at most ``room`` and hash <= t2.  ``room`` is what the first threshold
    leaves of the budget because the next row by hash is larger; the second
    search spends it on rows that fit, so a long text at the boundary does
    not leave its source far from the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.select("source", "source_size", "target", whole.cast("bigint").alias("copies"))
    state = write_table(state.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")),
                        folder, "budgets")
    rows = sized.select("source", "size", "hash").where("size > 0")
    first = write_table(_crossing(rows, state, folder, "first"), folder, "first")
    f = first.select(F.col("source").alias("s"), F.col("threshold").alias("t1"), F.col("left").alias("room"))
    rest = rows.join(f, null_safe(F.col("source"), F.col("s"))).where("hash > t1 and size <= room")
    second = _crossing(rest.select("source", "size", "hash"), first, folder, "second")
    g = second.select(F.col("source").alias("s2"), F.col("threshold").alias("t2"))
    out = state.join(f, null_safe(F.col("source"), F.col("s"))).join(g, null_safe(F.col("source"), F.col("s2")))
    return write_table(out.select("source", "source_size", "target", "copies", "t1", "room", "t2"), folder, "limits")


def _times(size: Column, hash_: Column, limit) -> Column:
    """Copies of a row; ``limit`` gives the column of a name of ``thresholds``."""
    more = (hash_ <= limit("t1")) | ((size <= limit("room")) & (hash_ <= limit("t2")))
    return (limit("copies") + F.when(more, 1).otherwise(0)).cast("bigint")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, budget: float = 1.0, cap: int = CAP) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) for every row of ``docs``."""
    folder = work_folder(docs.sparkSession, "mix")
    sized = write_table(sizes(docs, key, text, source), folder, "sizes")
    limit = thresholds(sized, source_targets(sized, folder, weights, budget, cap), folder)
    out = sized.join(limit.withColumnRenamed("source", "s"), null_safe(F.col("source"), F.col("s")))
    out = out.withColumn("times", _times(F.col("size"), F.col("hash"), F.col))
    return out.select("key", "source", "size", "source_size", "target", F.col("times").alias("copies"),
                      (F.col("times") * F.col("size")).alias("taken"))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each once, with its number of copies in ``copies``.

    Thresholds are joined to the documents by source (a small written table,
    broadcast while it is below Spark's threshold), so texts are not shuffled.
    Where ``docs`` has a column copies, the number is in another, last column.
    """
    folder = work_folder(docs.sparkSession, "mix")
    sized = write_table(sizes(docs, key, text, source), folder, "sizes")
    limit = thresholds(sized, source_targets(sized, folder, **options), folder)
    names = {c: fresh_name(docs, f"mix_{c}") for c in ("source", "copies", "t1", "room", "t2")}
    limit = limit.select(*[F.col(c).alias(n) for c, n in names.items()])
    out = docs.join(limit, null_safe(F.col(f"`{source}`"), F.col(names["source"])))
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0))
    label = "copies" if "copies" not in {c.lower() for c in docs.columns} else fresh_name(docs, "copies")
    times = _times(size, key_hash(key), lambda c: F.col(names[c]))
    return out.withColumn(label, times).where(F.col(label) > 0).select(
        *[F.col(f"`{c}`") for c in docs.columns], label)
