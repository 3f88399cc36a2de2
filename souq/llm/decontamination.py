"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max bounds.

The test items are indexed, and every passage of every training text is a
query.  A passage is a window of two segments of M words, M the words of the
longest item, so every run of M words lies in one window.  An item's score is
its BM25 sum over the terms it shares with the passage, divided by the sum
over all its terms; 1 means that the passage has every term of the item.

All items with a score of at least ``threshold`` are wanted (not a top k), so
the bound to beat is fixed: items stand in blocks, every term keeps the
largest impact it has in each block, and the impacts of a passage's terms are
summed by block first (the block-max step; by segment, as a window cannot
exceed the sum of its two).  Only blocks that reach the threshold have their
postings read and their items scored.  Every retrieved item is then verified
on the word sequence: at least ``overlap`` of its question's and of its
answer's word n-grams must stand in the passage.  The question is all but
the item's last line or, on one line, its last sentence; the answer is the
rest.  Texts of one sentence are a question only.

The index is fitted to the items alone and does not grow with the corpus.  It
is broadcast in blocks of items of at most ``INDEX_BYTES`` of item text; the
corpus is read once for each such block (one, unless the benchmark exceeds
the bound).  Document frequencies cover the whole benchmark.

Words are lower-cased, runs of letters and digits compare (marks are dropped).
Null and empty texts have no passages and no hits.  Items that are null or
without a word match nothing.  Equal items each hit.  Repeated rows hit alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souq.llm.common import WORD, fresh_name

K1, B = 1.2, 0.75
THRESHOLD = 0.7
OVERLAP = 0.8
NGRAM = 3
BLOCK = 8                         # items a block
INDEX_BYTES = 32 << 20
MARKS = re.compile(r"[^\w\s]+|_+")

def hit_type(item: T.DataType) -> T.StructType:
    """A found item, under the benchmark's own type of id."""
    return T.StructType([T.StructField("item_id", item), T.StructField("score", T.DoubleType()),
                    T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())])


def words_of(text: str | None) -> list[str]:
    """Lower-cased words with marks removed; words of marks alone vanish."""
    return MARKS.sub("", (text or "").lower()).split()


def question_answer(text: str) -> tuple[str, str]:
    """Split an item at its last line or, on one line, at its last sentence."""
    text = text.strip()
    head, _, tail = text.rpartition("\n")
    if not head.strip() or not tail.strip():
        head, tail = "", text
        if m := list(re.finditer(r"[.?!]\s+", text)):
            head, tail = text[:m[-1].end()], text[m[-1].end():]
    return (head, tail) if words_of(head) and words_of(tail) else (text, "")


def _grams(w: list, n: int) -> set:
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


class Index:
    """Inverted lists of a bounded set of items, with an upper bound for each term and block."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float):
        self.longest = max([1, *(len(words_of(t)) for _, t in items)])
        self.ids, self.parts, postings = [], [], {}
        for item, text in items:
            w = words_of(text)
            if not w:
                continue
            k = len(self.ids)
            tf: dict[str, int] = {}
            for x in w:
                tf[x] = tf.get(x, 0) + 1
            norm = K1 * (1 - B + B * len(w) / max(mean_words, 1e-9))
            impact = {x: math.log(1 + (n_items - df[x] + 0.5) / (df[x] + 0.5)) * c * (K1 + 1) / (c + norm)
                      for x, c in tf.items()}
            full = sum(impact.values())
            for x, v in impact.items():
                postings.setdefault(x, []).append((k, v / full))
            q, a = question_answer(text)
            self.ids.append(item)
            self.parts.append((words_of(q), words_of(a)))
        self.term = {x: i for i, x in enumerate(postings)}
        self.n_blocks = -(-len(self.ids) // BLOCK)
        lists = list(postings.values())
        self.post_at = np.cumsum([0] + [len(p) for p in lists])
        self.post_item = np.array([k for p in lists for k, _ in p], dtype=np.int64)
        self.post_impact = np.array([v for p in lists for _, v in p], dtype=np.float64)
        blocks = []
        for p in lists:
            top: dict[int, float] = {}
            for k, v in p:
                top[k // BLOCK] = max(top.get(k // BLOCK, 0.0), v)
            blocks.append(sorted(top.items()))
        self.block_at = np.cumsum([0] + [len(p) for p in blocks])
        self.block_no = np.array([b for p in blocks for b, _ in p], dtype=np.int64)
        self.block_max = np.array([v for p in blocks for _, v in p], dtype=np.float64)


def _spread(at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists [at[t], at[t+1]): the position of every entry, and which of ``terms`` it is of."""
    n = at[terms + 1] - at[terms]
    owner = np.repeat(np.arange(len(terms)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[terms], n), owner


def search(index: Index, text: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
    """Verified hits of one text: (item, score, question overlap, answer overlap), best window of each item."""
    w = words_of(text)
    ids = np.fromiter(map(index.term.get, w, repeat(-1)), dtype=np.int64, count=len(w))
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return []
    m, width = index.longest, max(1, len(index.term))
    n_seg = len(w) // m + 1
    hits: dict[int, tuple] = {}
    step = max(1, 4_000_000 // max(1, index.n_blocks))     # segments at a time: bounded memory
    for lo in range(0, n_seg, step):
        part = at[(at >= lo * m) & (at < (lo + step + 1) * m)]
        pair = np.unique((part // m) * width + ids[part])      # distinct terms of every segment
        seg, term = pair // width - lo, pair % width
        n = min(step + 1, n_seg - lo)
        pos, owner = _spread(index.block_at, term)
        bound = np.bincount(seg[owner] * index.n_blocks + index.block_no[pos], weights=index.block_max[pos],
                            minlength=(n + 1) * index.n_blocks).reshape(n + 1, index.n_blocks)
        live = bound[:-1] + bound[1:] >= threshold - 1e-9
        live = live[:min(step, n_seg - lo)]
        for s in np.flatnonzero(live.any(axis=1)):
            seen = np.unique(term[(seg == s) | (seg == s + 1)])
            pos, _ = _spread(index.post_at, seen)
            pos = pos[live[s][index.post_item[pos] // BLOCK]]
            score = np.bincount(index.post_item[pos], weights=index.post_impact[pos], minlength=len(index.ids))
            found = np.flatnonzero(score >= threshold - 1e-9)
            if not len(found):
                continue
            begin = (lo + s) * m
            window = w[begin:begin + 2 * m]
            grams = {n: _grams(window, n) for n in range(1, NGRAM + 1)}
            for k in found:
                shares = []
                for words in index.parts[k]:
                    want = _grams(words, NGRAM)
                    size = min(NGRAM, len(words)) or 1
                    shares.append(len(want & grams[size]) / len(want) if want else None)
                q, a = shares
                if q >= overlap and (a is None or a >= overlap):
                    best = (index.ids[k], float(score[k]), float(q), None if a is None else float(a))
                    if index.ids[k] not in hits or best[1:3] > hits[index.ids[k]][1:3]:
                        hits[index.ids[k]] = best
    return [hits[i] for i in sorted(hits)]


def build_indexes(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                  index_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over blocks of items of at most ``index_bytes`` of text each (checked before collecting)."""
    items = benchmark.select(F.col(f"`{item}`").alias("item"),
                             F.col(f"`{text}`").alias("text")).where("item is not null and text is not null")
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\p{M}\x20\x09-\x0D]+|_+", "")
    size = items.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    if not size[0]:
        return
    n_shards = -(-size[0] // max(1, index_bytes - (size[1] or 0)))
    words = items.select("item", F.size(F.regexp_extract_all(plain, F.lit(f"({WORD})"), F.lit(1))).alias("n"))
    n_items, mean = words.where("n > 0").agg(F.count("*"), F.avg("n")).first()
    for shard in range(n_shards):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(n_shards)) == shard) if n_shards > 1 else items
        rows = sorted((r["item"], r["text"]) for r in own.toLocalIterator())
        vocabulary = {x for _, t in rows for x in words_of(t)}
        df: dict[str, int] = dict.fromkeys(vocabulary, 0)
        if n_shards == 1:
            for _, t in rows:
                for x in set(words_of(t)):
                    df[x] += 1
        else:
            for batch in items.select("text").mapInArrow(_document_words, "w string").groupBy("w").count() \
                    .toLocalIterator():
                if batch["w"] in df:
                    df[batch["w"]] = batch["count"]
        yield Index(rows, df, n_items or 0, mean or 0.0)


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([x for t in b.column(0).to_pylist() for x in set(words_of(t))],
                                                   pa.string())], names=["w"])


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", hits: str = "hits",
              threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES,
              item: str = "item_id") -> DataFrame:
    """``docs`` with one more column ``hits``: an array of (item_id, score, question_overlap, answer_overlap).

    One pass over the texts for each block of items, no shuffle.
    """
    hit = T.ArrayType(hit_type(benchmark.schema[item].dataType))
    out = docs.withColumn(hits, F.array().cast(hit))
    for index in build_indexes(benchmark, item, index_bytes=index_bytes):
        found = _searcher(docs.sparkSession.sparkContext.broadcast(index), threshold, overlap, hit)
        out = out.withColumn(hits, F.concat(hits, found(F.col(f"`{text}`"))))
    return out


def _searcher(shared, threshold: float, overlap: float, hit: T.DataType):
    @F.udf(hit, useArrow=True)
    def find(text):
        return search(shared.value, text, threshold, overlap) if text else []
    return find


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  **options) -> DataFrame:
    """One row for each document and item that it contains: (key, item_id, score and overlaps)."""
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return with_hits(d, benchmark, "text", "hits", **options).select("key", F.explode("hits").alias("h")) \
        .select("key", "h.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text contains no test item; same columns."""
    hits = fresh_name(docs, "hits")
    return with_hits(docs, benchmark, text, hits, **options).where(F.size(hits) == 0).drop(hits)
