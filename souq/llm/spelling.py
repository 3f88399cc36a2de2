"""Spelling variants: words one inserted, deleted or replaced letter apart, by pairs of trie nodes.

* Words.  Runs of the letters ``[A-Za-z]`` and U+00C0 to U+00FF, A-Z
  lower-cased.  One run in ``DAMAGE`` (by a checksum of ``<key>:<run>``) loses a
  letter, which gives the search known misspellings.  Results of ``LEAST``
  letters and more are counted, in tasks first, and those with ``OFTEN``
  occurrences are the dictionary, sorted and numbered so that numbers order
  words as code points do.
* Trie nodes.  Every prefix is a node of the forward trie, every suffix one of
  the reversed trie, and each node gets an integer.  A node of up to HEAD
  letters is its letters in base 91.  Deeper nodes lie below one node of HEAD
  letters; the task that holds this subtree's words in order numbers what each
  word adds to the word before it.  Equal integers are equal strings.
* Pairs.  A word of L letters *skips* position i by (node of the i letters
  before it, node of the L - i - 1 letters after it) and *splits* at i by (node
  of the first i letters, node of the rest).  Two words that skip to one pair
  differ by one replaced letter.  A word that skips to the pair at which another
  splits has one letter more.  Within a run of equal letters only the first one
  counts for that, so no pair of words is met twice.
* A pair's skips differ in one letter, so at most 90 words share it, and one
  word at most splits at it: groups have a proven bound.  Every member takes the
  number and the best of its group's others; pairs of words are never made.
* Forms.  A word's form is its near word with the largest count (ties: the
  first in code-point order), where that has at least ``TIMES`` the word's own.
  Counts grow along forms, so the chain to the last one, the root, ends; it is
  followed by doubling.

Null and empty texts have no words.  Texts are read in stretches that end
between words, so a text's length does not matter; neither does a word's (nodes
are linear in its length).  A null key reads as the empty string in the
checksum.  Rows equal in key and text count each.  Other columns are not read.
An empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souq.llm.common import utf8_view, work_folder, write_table

LEAST = 6
OFTEN = 5
TIMES = 5
DAMAGE = 199
HEAD = 6
#: Bytes of a text that are searched at once, and counted words that a task holds.
STRETCH = 1 << 20
HELD = 1 << 18

#: In UTF-8, U+00C0 to U+00FF are 0xC3 and one byte more; a run of fewer bytes than letters asked for is too short.
_RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = False


def _letters(run: bytes) -> int:
    return len(run) - run.count(b"\xc3")


def _damaged(run: bytes, at: int) -> bytes:
    word = run.decode()
    at %= len(word)
    return (word[:at] + word[at + 1:]).encode()


def _stretches(data: np.ndarray) -> Iterator[bytes]:
    """The bytes, lower-cased, in parts that end where no run goes on."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + STRETCH)
        while hi < len(data):
            gaps = np.flatnonzero(_GAP[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
                break
            hi = min(len(data), 2 * hi - lo)
        yield data[lo:hi].tobytes().lower()
        lo = hi


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"])
        counts.clear()
        return out

    for b in batches:
        data, off = utf8_view(b.column("text"))
        for i, key in enumerate(b.column("key").to_pylist()):
            seed = zlib.crc32(b"%s:" % (key or "").encode())
            for part in _stretches(data[off[i]:off[i + 1]]):
                for run, n in Counter(_RUN.findall(part)).items():
                    if len(run) < LEAST or (size := _letters(run)) < LEAST:
                        continue
                    h = zlib.crc32(run, seed)
                    if h % DAMAGE == 0:
                        if size == LEAST:
                            continue
                        run = _damaged(run, h)
                    counts[run] += n
                if len(counts) >= HELD:
                    yield flush()
    if counts:
        yield flush()


def dictionary(docs: DataFrame, folder: str, key: str, text: str) -> DataFrame:
    """(w, word, n), w in the order of the words."""
    d = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    words = d.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = words.where(F.col("n") >= OFTEN).orderBy("word")
    return write_table(words.select(F.monotonically_increasing_id().alias("w"), "word", "n"), folder, "words")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all prefixes of every word, empty one first, and which letters differ from the one before.

    The words of a subtree come in order.
    """
    base, used = (TaskContext.get().partitionId() + 1) << 40, 0
    before, path = np.zeros(0, np.int64), []
    for b in batches:
        lists, firsts = [], []
        for word in b.column("word").to_pylist():
            code = np.frombuffer(word.encode("latin-1"), np.uint8).astype(np.int64)
            code = np.where(code < 128, code - 96, code - 0xC0 + 27)
            n = min(len(code), len(before))
            differ = np.flatnonzero(code[:n] != before[:n])
            same = int(differ[0]) if len(differ) else n
            if same < HEAD:
                node, path = 0, [0]
                for c in code[:HEAD].tolist():
                    node = node * 91 + c
                    path.append(node)
                same = HEAD
            path = path[:same + 1]
            new = len(code) - same
            path += range(base + used, base + used + new)
            used += new
            before = code
            lists.append(path)
            firsts.append(np.append(True, code[1:] != code[:-1]))
        yield pa.RecordBatch.from_arrays([b.column("w"), pa.array(lists, pa.list_(pa.int64())),
                                          pa.array(firsts, pa.list_(pa.bool_()))], names=["w", "nodes", "firsts"])


def _nodes(words: DataFrame, word: Column) -> DataFrame:
    x = words.select("w", word.alias("word")).withColumn("head", F.substring("word", 1, HEAD))
    return (x.repartition("head").sortWithinPartitions("word").select("w", "word")
            .mapInArrow(_number, "w bigint, nodes array<bigint>, firsts array<boolean>"))


def pairs(words: DataFrame) -> DataFrame:
    """(p, s, split, first, w, n): every skip and split of every word; ``first`` of a run of equal letters."""
    forward = _nodes(words, F.col("word")).withColumnRenamed("nodes", "p")
    back = _nodes(words, F.reverse("word")).select("w", F.col("nodes").alias("s"))
    x = words.join(forward, "w").join(back, "w").withColumn("last", F.size("p") - 1)
    # a word makes many rows: a number that is given is kept, however few bytes the words have
    x = x.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "w")
    skip = F.expr("transform(sequence(0, last - 1), i -> struct(p[i] AS p, s[last - i - 1] AS s, false AS split, "
                  "firsts[i] AS first))")
    split = F.expr("transform(sequence(0, last), i -> struct(p[i] AS p, s[last - i] AS s, true AS split, true AS first))")
    return x.select("w", "n", F.explode(F.concat(skip, split)).alias("x")).select("x.*", "w", "n")


def near(words: DataFrame) -> DataFrame:
    """(w, n_near, best struct<less, w>): how many near words a word has, and the one with the largest count."""
    g = pairs(words).groupBy("p", "s").agg(F.collect_list(F.struct("split", "first", "w", "n")).alias("g"))
    others = ("filter(g, x -> x.w <> m.w AND CASE WHEN m.split THEN NOT x.split AND x.first "
              "WHEN x.split THEN m.first ELSE true END)")
    x = g.where(F.size("g") > 1).select(F.explode(F.expr(
        f"transform(g, m -> struct(m.w AS w, transform({others}, x -> struct(-x.n AS less, x.w AS w)) AS o))")).alias("x"))
    x = x.select("x.w", F.size("x.o").alias("n"), F.array_min("x.o").alias("best")).where("n > 0")
    return x.groupBy("w").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the dictionary."""
    spark = docs.sparkSession
    folder = work_folder(spark, "spelling")
    words = dictionary(docs, folder, key, text)
    x = words.join(near(words), "w", "left")
    x = x.select("w", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                 F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best")).alias("best"))
    x = write_table(x.select("w", "word", "n", "n_near", F.col("best.w").alias("form_w"),
                             (-F.col("best.less")).alias("form_n")), folder, "near")
    up = x.where("form_w IS NOT NULL").select("w", F.col("form_w").alias("root_w"))
    step = 0
    while True:                                        # each round doubles the distance covered
        on = up.select(F.col("w").alias("root_w"), F.col("root_w").alias("on_w"))
        far = up.join(on, "root_w", "left")
        up = write_table(far.select("w", F.coalesce("on_w", "root_w").alias("root_w"),
                                    F.col("on_w").isNotNull().alias("moved")), folder, f"roots-{step}")
        step += 1
        if not up.where("moved").take(1):
            break
        up = up.drop("moved")
    name = words.select(F.col("w").alias("name_w"), F.col("word").alias("name"))
    out = x.join(up.select("w", "root_w"), "w", "left")
    out = out.join(name.withColumnsRenamed({"name_w": "form_w", "name": "form"}), "form_w", "left")
    out = out.join(name.withColumnsRenamed({"name_w": "root_w", "name": "root"}), "root_w", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
