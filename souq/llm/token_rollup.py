"""Token counts as rollups maintained by signed deltas.

A batch of changes (insert, delete, revise) is turned into signed rows: the
counts that it takes back, with sign -1, and those that it adds, with +1.
They are kept in a ledger by document and summed into additive totals by
source, language and tokenizer version.  Totals are the sum of all committed
batches' deltas, so no batch ever recounts the corpus.

A batch is a folder of ledger rows, a folder of deltas and, last, a commit
mark.  Folders are overwritten as a whole and only marked batches count, so a
batch that broke off can run again, and one that is committed is not applied
twice.

Within a batch a key may occur several times: the last by ``seq`` counts, the
greatest text on a tie (so repeated rows are one document).  An insert of a
known key revises it; a revision of an unknown one inserts it; its deletion
does nothing.  A change that is null or none of these three is an error.  Batch
names are any text.  Two writers of one batch: one of them fails.  Rows without a key are keyed by their text.  Null text counts 0
tokens.  Null sources and languages are groups of their own.  Empty batches
commit and add nothing.  Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souq.llm.common import WORD, null_safe

#: The usual splitting of text before byte-level BPE: contractions, letters, digits, marks, spaces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
WORDS = "words"
OPS = ("insert", "delete", "revise")
LEDGER = "key string, source string, lang string, version string, tokens bigint, sign int"
DELTA = "source string, lang string, version string, docs bigint, tokens bigint"


def _bpe_counter(sc, path: str):
    """Counts of byte-level BPE tokens; the vocabulary (a file of fixed size) is broadcast."""
    with open(path, "rb") as f:
        shared = sc.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in shared.value.splitlines() if x.strip())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [0 if t is None else len(encode(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "seq", "op", "source", "lang", "digest")),
                                              pa.array(n, pa.int64()), b.column("n_words")],
                                             names=["key", "seq", "op", "source", "lang", "digest", "n", "n_words"])
    return count


class TokenRollup:
    """Totals kept in ``folder``; ``tokenizer`` is the path of a tiktoken vocabulary, ``version`` its label.

    Every document is counted in two versions: ``version`` and plain words.
    """

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str, version: str):
        self.spark, self.folder, self.tokenizer, self.version = spark, folder.rstrip("/"), tokenizer, version

    def _path(self, kind: str, batch: str) -> str:
        return f"{self.folder}/{kind}/" + quote(batch, safe="").replace(".", "%2E")

    def committed(self) -> list[str]:
        """Names of the committed batches."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(unquote(x.getPath().getName()) for x in fs.listStatus(path)) if fs.exists(path) else []

    def _mark(self, batch: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path("commits", batch))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, False).close()

    def _read(self, kind: str, schema: str) -> DataFrame:
        names = self.committed()
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._path(kind, n) for n in names])

    def counted(self, changes: DataFrame, key: str, text: str, source: str, lang: str, op: str | None,
                seq: str | None) -> DataFrame:
        """(key, op, source, lang, version, tokens): the last change of every key, counted in every version."""
        what = F.col(f"`{op}`") if op else F.lit("insert")
        what = F.when(what.isin(*OPS), what).otherwise(F.raise_error(F.lit(f"a change is one of {', '.join(OPS)}")))
        d = changes.select(
            F.coalesce(F.concat(F.lit("="), F.col(f"`{key}`").cast("string")),
                       F.concat(F.lit("~"), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))).alias("key"),
            (F.col(f"`{seq}`").cast("bigint") if seq else F.lit(0).cast("bigint")).alias("seq"),
            what.cast("string").alias("op"),
            F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{lang}`").cast("string").alias("lang"),
            F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("digest"),
            F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_words"),
            F.when(what != "delete", F.col(f"`{text}`")).alias("text"))
        n = d.mapInArrow(_bpe_counter(self.spark.sparkContext, self.tokenizer),
                         "key string, seq bigint, op string, source string, lang string, digest string, "
                         "n bigint, n_words bigint")
        last = n.groupBy("key").agg(F.max(F.struct("seq", "digest", "op", "source", "lang", "n", "n_words")).alias("c"))
        versions = F.array(F.struct(F.lit(self.version).alias("version"), F.col("c.n").alias("tokens")),
                           F.struct(F.lit(WORDS).alias("version"), F.col("c.n_words").alias("tokens")))
        return last.select("key", "c.op", "c.source", "c.lang", F.inline(versions))

    def commit(self, batch: str, changes: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
               lang: str = "lang", op: str | None = None, seq: str | None = None) -> bool:
        """Apply a batch once; False if it had been committed before.

        Without ``op`` all rows are inserts.  Texts are read once and never shuffled: each
        row becomes its counts where it is read.
        """
        if batch in self.committed():
            return False
        work = self._path("changes", batch)
        self.counted(changes, key, text, source, lang, op, seq).write.mode("overwrite").parquet(work)
        new = self.spark.read.parquet(work)
        held = self._read("ledger", LEDGER).join(new.select("key").distinct(), "key", "left_semi") \
            .groupBy("key", "source", "lang", "version") \
            .agg(F.sum(F.col("tokens") * F.col("sign")).alias("tokens"), F.sum("sign").alias("n")).where("n > 0")
        back = held.select("key", "source", "lang", "version", "tokens", F.lit(-1).alias("sign"))
        add = new.where("op <> 'delete'").select("key", "source", "lang", "version", "tokens", F.lit(1).alias("sign"))
        back.unionByName(add).write.mode("overwrite").parquet(self._path("ledger", batch))
        rows = self.spark.read.schema(LEDGER).parquet(self._path("ledger", batch))
        rows.groupBy("source", "lang", "version").agg(
            F.sum("sign").cast("bigint").alias("docs"), F.sum(F.col("tokens") * F.col("sign")).alias("tokens")) \
            .write.mode("overwrite").parquet(self._path("delta", batch))
        self._mark(batch)
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all committed batches; groups without documents are left out."""
        return self._read("delta", DELTA).groupBy("source", "lang", "version") \
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")


def takedown(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deletions of the documents that ``labels`` marks as toxic, as a batch of changes."""
    bad = labels.where("toxic = 1").select(F.col(key).alias("bad")).distinct()
    narrow = docs.select(key, "source", "lang", F.lit(None).cast("string").alias("text"))
    return narrow.join(bad, null_safe(F.col(key), F.col("bad")), "left_semi").withColumn("op", F.lit("delete"))
