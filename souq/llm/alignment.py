"""Two tokenizers' tokens of the same text, aligned by their byte ranges.

Tokenizer A (byte-level BPE, a ``tokenizers`` file) encodes a space and the
text; B (a sentencepiece model with byte fallback) encodes the text and adds the
space itself.  Special tokens' strings in a text are ordinary text.  Tokens are
turned back into bytes; a text is aligned only if both sides' bytes are those
of the space and the text, else it has no tokens.

* Overlaps.  Within a batch, ``merge_asof`` keyed by document finds for every
  start of an A token the B token that covers it, and the other way round.  The
  union of both is every pair of tokens that share a byte.
* Links are the overlaps whose ranges end together.  Each ends a *group*: the
  tokens of both sides between two places where both end.
* An id pair's count is the number of its links in all documents.  A document's
  distinct pairs are counted in the batch, so that what is summed is small.
* The counts come back to the documents by two joins.  The most frequent pairs,
  at most ``FREQUENT``, are broadcast (a bound that does not depend on the
  corpus); links of the other, rare pairs are joined by shuffling.  So no pair
  gathers more rows than a rare one has.

Texts are encoded in parts (see ``Pair``), equal ones once.  Null and empty
texts have no tokens.  Rows of equal or null key are documents of their own.  Vocabularies
travel by broadcast, so only the driver reads their files.  Other columns are
not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, filterfalse
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souq.llm.common import pieces, utf8_view, work_folder, write_table

FREQUENT = 1 << 17
PIECE = 1 << 18
#: Files of the counts, of which there are as many as pairs of ids at most.
COUNT_FILES = 16
#: Characters of the parts whose tokens a process remembers.
HELD = 1 << 22

_CUT = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict = {}


def _byte_letters() -> dict[str, int]:
    """The letter of every byte in a byte-level vocabulary: itself where it prints, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Bytes, their number and the decimal id of every token of one side."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.names = {}
        for end in (b",", b"|", b";"):
            self.names[end] = np.empty(len(tokens), object)
            self.names[end][:] = [b"%d%s" % (i, end) for i in range(len(tokens))]

    def bytes(self, ids: list[int]) -> bytes:
        t = self.tokens
        return b"".join([t[i] for i in ids])


class Side(NamedTuple):
    """Tokens of a batch on one side: ids, how many each document has, and where they end, bytes counted through."""

    ids: np.ndarray
    counts: np.ndarray
    ends: np.ndarray

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


class Pair:
    """Both encoders, built from the files' contents.

    Texts are cut before single spaces between other characters: neither side
    has a token across such a place (B's vocabulary is looked at; where it has
    one, texts stay whole).  Equal parts are encoded once; the parts held are
    bounded by their length.
    """

    def __init__(self, a: bytes, b: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._a = Tokenizer.from_str(a.decode())
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letter = _byte_letters()
        names = {i: t for t, i in self._a.get_vocab(with_added_tokens=True).items()}
        self.a = Vocabulary([b"".join(bytes([letter[c]]) if c in letter else c.encode() for c in names.get(i, ""))
                             for i in range(max(names) + 1)])
        n = self._b.get_piece_size()
        pieces_b = [self._b.id_to_piece(i) for i in range(n)]
        self.b = Vocabulary([bytes([int(t[3:5], 16)]) if self._b.is_byte(i) else t.replace("▁", " ").encode()
                             for i, t in enumerate(pieces_b)])
        self._cut = not any(re.search("[^▁]▁", t) for t in pieces_b)
        self._forget()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, Side, Side]:
        """Which texts have tokens, and the tokens of these."""
        if self._held > HELD:
            self._forget()
        of = [_CUT.split(t) if self._cut else [t] for t in texts]
        new = list(dict.fromkeys(filterfalse(self._code.__contains__, chain.from_iterable(of))))
        if new:
            self._learn(new)
        parts = np.array([len(x) for x in of])
        codes = np.fromiter(map(self._code.__getitem__, chain.from_iterable(of)), np.int64, parts.sum())
        row = np.repeat(np.arange(len(texts)), parts)
        keep = np.ones(len(texts), bool)
        for i in np.unique(row[~self._good[codes]]):
            keep[i] = self._equal(texts[i], codes[row == i])
        codes, row = codes[keep[row]], (np.cumsum(keep) - 1)[row[keep[row]]]
        return keep, *(self._gather(side, codes, row, int(keep.sum())) for side in (0, 1))

    def _forget(self) -> None:
        self._code: dict[str, int] = {}
        self._good = np.zeros(0, bool)
        self._held = 0
        self._ids = [np.zeros(0, np.int32)] * 2       # of all parts, one after the other
        self._ends = [np.zeros(1, np.int64)] * 2

    def _learn(self, parts: list[str]) -> None:
        both = ([x.ids for x in self._a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)],
                self._b.encode(parts, num_threads=1))
        good = np.ones(len(parts), bool)
        raw = [b" " + p.encode() for p in parts]
        length, whole = np.fromiter(map(len, raw), np.int64, len(raw)), b"".join(raw)
        for side, (v, lists) in enumerate(zip((self.a, self.b), both)):
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int32, size.sum())
            ends = np.append(0, np.cumsum(v.size[flat]))[np.cumsum(size)]
            if not (np.array_equal(ends, np.cumsum(length)) and v.bytes(flat.tolist()) == whole):
                good &= [v.bytes(x) == r for x, r in zip(lists, raw)]
            self._ids[side] = np.concatenate([self._ids[side], flat])
            self._ends[side] = np.concatenate([self._ends[side], self._ends[side][-1] + np.cumsum(size)])
        self._code.update(zip(parts, range(len(self._good), len(self._good) + len(parts))))
        self._good = np.concatenate([self._good, good])
        self._held += sum(map(len, parts))

    def _equal(self, text: str, codes: np.ndarray) -> bool:
        """The rule itself, for texts with a part that differs."""
        return all(v.bytes(self._gather(side, codes, np.zeros(len(codes), np.int64), 1).ids.tolist())
                   == b" " + text.encode() for side, v in enumerate((self.a, self.b)))

    def _gather(self, side: int, codes: np.ndarray, row: np.ndarray, n: int) -> Side:
        first = self._ends[side][codes]
        length = self._ends[side][codes + 1] - first
        ids = self._ids[side][np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length), length)]
        return Side(ids.astype(np.int64), np.bincount(row, length, n).astype(np.int64),
                    np.cumsum((self.a, self.b)[side].size[ids]))


def load(files: Broadcast) -> Pair:
    """The encoders of a broadcast pair of files; one pair is kept in a process."""
    name, a, b = files.value
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Pair(a, b)
    return _loaded[name]


def _frame(name: str, side: Side, size: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"start": side.ends - size[side.ids], "doc": side.docs(), name: np.arange(len(side.ids))})


def overlaps_of(a: Side, b: Side, pair: Pair) -> pd.DataFrame:
    """(a_at, b_at, linked): all pairs of tokens that share a byte, places counted over the batch.

    Documents' bytes are counted through, equally on both sides.
    """
    left, right = _frame("a", a, pair.a.size), _frame("b", b, pair.b.size)
    one = pd.merge_asof(left, right, on="start", by="doc")
    two = pd.merge_asof(right, left, on="start", by="doc")
    new = two["start"].to_numpy() != left["start"].to_numpy()[two["a"].to_numpy()]   # those that start together are in both
    a_at = np.concatenate([one["a"].to_numpy(), two["a"].to_numpy()[new]])
    b_at = np.concatenate([one["b"].to_numpy(), two["b"].to_numpy()[new]])
    return pd.DataFrame({"a_at": a_at, "b_at": b_at, "linked": a.ends[a_at] == b.ends[b_at]}, copy=False)


def _groups(pair: Pair, cuts: np.ndarray, a: Side, b: Side) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every document; groups end at ``cuts``."""
    group, names = [], []
    for side, vocabulary, end in ((a, pair.a, b"|"), (b, pair.b, b";")):
        g = np.searchsorted(cuts, side.ends)
        last = np.append(g[1:] != g[:-1], True)
        group.append(g * 2 + (end == b";"))
        names.append(np.where(last, vocabulary.names[end][side.ids], vocabulary.names[b","][side.ids]))
    order = np.argsort(np.concatenate(group), kind="stable")
    names = np.concatenate(names)[order].tolist()
    cut = np.append(0, np.cumsum(a.counts + b.counts)).tolist()  # groups never cross documents
    return [b"".join(names[lo:hi])[:-1] for lo, hi in zip(cut[:-1], cut[1:])]


def _usable(pair: Pair, texts: list[str | None]) -> tuple[np.ndarray, Side, Side]:
    """The places of the texts that have tokens, and these."""
    at = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(at):
        return at, None, None
    keep, a, b = pair.encode([texts[i] for i in at])
    return at[keep], a, b


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for b in batches:
        _, off = utf8_view(b.column("text"))
        for lo, hi in pieces(off, PIECE):
            part = b.slice(lo, hi - lo)
            yield part, part.column("text").to_pylist()


def _encoder(files: Broadcast, text_of_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = load(files), TaskContext.get().partitionId() << 40
        for part, texts in _batches(batches):
            n = len(texts)
            at, a, b = _usable(pair, texts)
            counts = np.zeros((3, n), np.int64)
            groups, pairs, times, ends = [b""] * n, np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
            if len(at):
                x = overlaps_of(a, b, pair)
                a_at = x["a_at"].to_numpy()[x["linked"].to_numpy()]
                b_at = x["b_at"].to_numpy()[x["linked"].to_numpy()]
                doc = at[a.docs()[a_at]]
                counts[0, at], counts[1, at] = a.counts, b.counts
                counts[2] = np.bincount(doc, minlength=n)
                size = len(pair.a.tokens), len(pair.b.tokens)
                code, times = np.unique((doc * size[0] + a.ids[a_at]) * size[1] + b.ids[b_at], return_counts=True)
                pairs = (code // size[1] % size[0] << 32) | code % size[1]
                ends = np.append(0, np.cumsum(np.bincount(code // (size[0] * size[1]), minlength=n)))
                for i, g in zip(at.tolist(), _groups(pair, np.sort(a.ends[a_at]), a, b)):
                    groups[i] = g if text_of_groups else hashlib.sha256(g).hexdigest().encode()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), part.column("key"), *map(pa.array, counts),
                 pa.array(groups, pa.binary()).cast(pa.string()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs, pa.int64())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int32()))],
                names=["row", "key", "n_a", "n_b", "n_links", "groups", "pairs", "times"])
            row += n
    return run


def _files(docs: DataFrame, a: str, b: str) -> Broadcast:
    with open(a, "rb") as x, open(b, "rb") as y:
        contents = x.read(), y.read()
    name = hashlib.sha256(b"".join(contents)).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((name, *contents))


def encode(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text",
           groups: str = "sha256") -> DataFrame:
    """(row, key, n_a, n_b, n_links, groups, pairs, times) of every document.

    ``groups`` is the groups' text (``groups="text"``) or its digest, empty
    without tokens; ``pairs`` are the distinct linked ids (A's times 2**32, plus
    B's) and ``times`` their links.  Each link ends one group.
    """
    if groups not in ("text", "sha256"):
        raise ValueError("groups is 'text' or 'sha256'")
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = d.schema["key"].dataType.simpleString()
    return d.mapInArrow(_encoder(_files(docs, a, b), groups == "text"),
                        f"row bigint, key {kind}, n_a bigint, n_b bigint, n_links bigint, groups string, "
                        "pairs array<bigint>, times array<int>")


def overlaps(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, a_at, b_at, a, b, linked): every pair of tokens of a document that share a byte; places from 0."""
    files = _files(docs, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(files)
        for part, texts in _batches(batches):
            at, x, y = _usable(pair, texts)
            if not len(at):
                continue
            o = overlaps_of(x, y, pair)
            a_at, b_at = o["a_at"].to_numpy(), o["b_at"].to_numpy()
            doc = x.docs()[a_at]
            first = [(np.cumsum(s.counts) - s.counts)[doc] for s in (x, y)]
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(at[doc])), pa.array(a_at - first[0]), pa.array(b_at - first[1]),
                 pa.array(x.ids[a_at]), pa.array(y.ids[b_at]), pa.array(o["linked"].to_numpy())],
                names=["key", "a_at", "b_at", "a", "b", "linked"])

    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = d.schema["key"].dataType.simpleString()
    return d.mapInArrow(run, f"key {kind}, a_at bigint, b_at bigint, a bigint, b bigint, linked boolean")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, n, best): links of every id pair, and whether no other pair of its B id has more."""
    x = encoded.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    x = x.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    x = x.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = x.groupBy("b").agg(F.max("n").alias("most"))
    return x.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", groups: str = "sha256",
          frequent: int = FREQUENT) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document."""
    folder = work_folder(docs.sparkSession, "alignment")
    encoded = write_table(encode(docs, a, b, key, text, groups), folder, "encoded")
    counts = write_table(pair_counts(encoded).coalesce(COUNT_FILES), folder, "counts")
    # the least power of two that at most ``frequent`` pairs reach
    level = F.floor(F.log2("n")).cast("int")
    least, held = 0, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect():
        held += r.c
        if held > frequent:
            least = 1 << (r.level + 1)
            break
    links = encoded.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    links = links.select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    often = F.broadcast(counts.where(F.col("n") >= least))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    found = links.join(often, "pair").groupBy("row").agg(*sums)
    if least:
        rare = links.join(often.select("pair"), "pair", "left_anti").join(counts.where(F.col("n") < least), "pair")
        found = found.union(rare.groupBy("row").agg(*sums)).groupBy("row").agg(
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = encoded.select("row", "key", "n_a", "n_b", "n_links", "groups").join(found, "row", "left")
    none = F.lit(0).cast("bigint")
    return out.select("key", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links",
                      F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"),
                      "groups")
