"""Substring search over stored texts by an index of character trigrams (P-03).

``LIKE '%q%'`` reads every text.  The index holds, for every three consecutive
characters (of the lower-cased text), the ids of the texts that contain them:

    <path>/postings   gram, block, ids (offsets within the block, ascending), n
    <path>/texts      id, text, stored by block

A block is ``BLOCK`` consecutive ids, so a posting list is cut into rows of
bounded size however frequent its trigram is.  Postings are stored in the order
of the trigrams, so that a lookup reads the row groups of its trigrams only, and
offsets are delta-encoded by the file format.  A pattern's literal parts give
the trigrams that every match has; the rarest few are intersected, the blocks
of the remaining ids are read, and LIKE itself decides on these texts.
Patterns without three literal characters in a row scan the stored texts.

New texts are appended as further rows.  Null texts match nothing; texts under
three characters have no trigrams and match only patterns that scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souq.operators.catalog import clean_search, like_pattern

#: Ids in a block.
BLOCK = 1 << 16
#: Trigrams of a pattern that are looked up, the rarest ones.
LOOKUPS = 4

_GRAMS = "(?s)(?=(.{3}))"


def literal_parts(pattern: str) -> list[str]:
    """The texts between the wildcards of a LIKE pattern, escapes resolved."""
    parts, part, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            part, i = part + pattern[i + 1], i + 2
            continue
        if c in "%_":
            parts.append(part)
            part = ""
        else:
            part += c
        i += 1
    return [p for p in [*parts, part] if p]


def grams_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_GRAMS)))


class TextIndex:
    """The index below ``path`` of texts (id, text); ids are non-negative integers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @property
    def texts(self) -> DataFrame:
        return self.spark.read.schema("id bigint, text string, block bigint").parquet(f"{self.path}/texts")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, block bigint, ids array<int>, n int, width int").parquet(
            f"{self.path}/postings")

    def add(self, texts: DataFrame, key: str, text: str, block: int = BLOCK) -> TextIndex:
        """Index further texts; an id may have several texts and matches if one does."""
        k = F.col(key)
        d = texts.where(F.col(text).isNotNull()).select(
            k.cast("bigint").alias("id"), F.col(text).alias("text"), F.floor(k / block).cast("bigint").alias("block"))
        (d.repartition("block").sortWithinPartitions("block", "id")
         .write.mode("append").partitionBy("block").parquet(f"{self.path}/texts"))
        at = (F.col("id") - F.col("block") * block).cast("int")
        rows = d.select("block", at.alias("at"), F.explode(grams_of(F.lower("text"))).alias("gram"))
        lists = rows.groupBy("gram", "block").agg(F.array_sort(F.collect_set("at")).alias("ids"))
        (lists.select("gram", "block", "ids", F.size("ids").alias("n"), F.lit(block).alias("width"))
         .repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")
         .write.mode("append").option("parquet.writer.version", "PARQUET_2_0")
         .option("parquet.enable.dictionary#ids.list.element", "false").parquet(f"{self.path}/postings"))
        return self

    def grams(self, pattern: str) -> list[str]:
        """The trigrams that every text matched by a (case-insensitive) LIKE pattern has."""
        lowered = self.spark.range(1).select(F.lower(F.lit(pattern)).alias("p")).first().p
        parts = (p.encode("utf-32-le", "surrogatepass") for p in literal_parts(lowered))
        points = ([p[i:i + 4] for i in range(0, len(p), 4)] for p in parts)
        return list(dict.fromkeys(b"".join(p[i:i + 3]).decode("utf-32-le", "surrogatepass")
                                  for p in points for i in range(len(p) - 2)))

    def candidates(self, pattern: str) -> DataFrame | None:
        """(block, id) of the texts that have the pattern's rarest trigrams; None where it has no trigram."""
        grams = self.grams(pattern)
        if not grams:
            return None
        counts = {r.gram: r.n for r in self.postings.where(F.col("gram").isin(grams)).groupBy("gram")
                  .agg(F.sum("n").alias("n")).collect()}
        if len(counts) < len(grams):                   # a trigram that no text has
            return self.postings.where("false").select("block", F.lit(0).cast("bigint").alias("id"))
        rare = sorted(grams, key=lambda g: (counts[g], g))[:LOOKUPS]
        ids = self.postings.where(F.col("gram").isin(rare)).select("gram", "block", "width", F.explode("ids").alias("at"))
        ids = ids.select("gram", "block", (F.col("block") * F.col("width") + F.col("at")).alias("id"))
        if len(rare) > 1:
            ids = ids.distinct().groupBy("block", "id").count().where(F.col("count") == len(rare))
        return ids.select("block", "id").distinct()

    def like(self, pattern: str) -> DataFrame:
        """(id) of the texts that match the LIKE pattern, in any case."""
        found, texts = self.candidates(pattern), self.texts
        if found is not None:
            texts = texts.join(found, ["block", "id"], "left_semi")
        return texts.where(F.col("text").ilike(pattern)).select("id").distinct()

    def search(self, text: str) -> DataFrame:
        """P-03 + P-08: (id) of the texts that contain the search text; none where there is no search."""
        s = clean_search(text)
        return self.like(like_pattern(s)) if s else self.texts.where("false").select("id")


def search_products(products: DataFrame, index: TextIndex, search: str, key: str = "product_id") -> DataFrame:
    """P-03 by the index of the descriptions; names, which are short, are matched on the product rows."""
    s = clean_search(search)
    if not s:
        return products
    hits = index.search(s).select(F.col("id").alias(key), F.lit(True).alias("_hit"))
    found = products.join(hits, key, "left")
    return found.where(F.col("name").ilike(like_pattern(s)) | F.coalesce("_hit", F.lit(False))).drop("_hit")


def searches(index: TextIndex, texts: list[str]) -> DataFrame:
    """(search, id) for several searches."""
    return reduce(DataFrame.unionByName, [index.search(t).select(F.lit(t).alias("search"), "id") for t in texts])
