"""Repeated word sequences removed by suffix automata of reference shards.

A window is ``LENGTH`` consecutive words of one document.  Every word that a
window covers whose sequence also starts in a document with a smaller id is
removed.  Windows are judged on the input; matches never cross documents.

* Anchors.  A window's anchor is the smallest hash of its ``GRAM``-word grams,
  so equal windows have equal anchors, and neighbouring windows mostly share
  one.  Windows of a document with the same anchor form a segment, a narrow row
  of the anchor, the document and the place.  Only anchors that two ids have
  can hold a repeat; this is counted with partial sums, so a frequent anchor is
  one row a task.
* Shards.  Equal sequences of the surviving segments are counted together, as
  hashes with their smallest id, before any words move.  Where an anchor has
  one sequence, all of it repeats.  The others' words, each sequence once, are
  the reference, dealt out by anchor, so whatever can match meets in one shard.  The segments
  of anchors found more than ``HOT`` times go on as single windows, each under
  the hash of all its words: what such a group gathers is one sequence, and the
  frequent anchor's edges, all different, are spread over all shards.
* Automata.  Each shard streams its sequences in the order of their smallest
  ids against the suffix automaton of all those with smaller ids.  The matching
  statistics (length of the longest match that ends at a word) of LENGTH or
  more mark the words to remove; what does not match whole is then added to the
  automaton.  An automaton holds at most SHARD words and one group more; a
  group has at most HOT segments.

Automata are sent where their shard's text is instead of to every task: the
repeated text grows with the corpus, so no bound holds for a broadcast of all
of it, and streaming every document against every shard would cost documents
times shards.

Steps are stored as narrow tables on shared storage, so a lost executor repeats
one step at most.  Words are compared by 64-bit hashes.

Null and empty texts have no words; texts of fewer than LENGTH words lose none.
A null id counts as larger than every other, two null ids as equal; rows with
equal ids are not smaller than each other, so both keep what only they share.
Rows equal in id and text get the same result.  Ids may be of any type that has
an order.  Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souq.llm.common import (_BASE, _INV, _SPACE, _pow, as_long, hashed_words, mix, null_safe, pieces, release, utf8_view, word_bounds,
                             work_folder, write_table)

LENGTH = 13
GRAM = 6
HOT = 1000
SHARD = 1 << 16
#: Rows of an output batch.
ROWS = 1 << 16

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(size):
        out = out * _STEP + words[j:j + len(out)]
    return mix(out)


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:len(h) - step], h[step:])
        have += step
    return h


def segments(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, number of windows, anchor) of every segment; ``rows`` are offsets into ``words``."""
    e = np.zeros(0, np.int64)
    if len(words) < LENGTH:
        return e, e, e, np.zeros(0, np.uint64)
    width = LENGTH - GRAM + 1
    low = _lowest(_grams(words, GRAM), width)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[:len(low)]
    at = np.flatnonzero(np.arange(len(low)) + LENGTH <= rows[1:][row])
    if not len(at):
        return e, e, e, np.zeros(0, np.uint64)
    low = low[at]
    new = np.append(True, (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(within % width == 0)       # equal grams in a row would make a segment as long as the text
    size = np.diff(np.append(first, len(at)))
    return row[at[first]], at[first] - rows[row[at[first]]], size, low[first]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, words, rows in hashed_words(b.column("text"), lower=False):
            row, _, _, h = segments(words, rows)
            take = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("fp").take(take),
                                              pa.array(as_long(h))], names=["id", "fp", "h"])


def _flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All elements of a list column, and the place of every row's first one (plus the total)."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.append(0, np.cumsum(n.astype(np.int64)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the segments whose anchors are asked of a text, the key of their group and the hash of their words."""
    for b in batches:
        asked, ends = _flat(b.column("asked"))
        hot, hot_ends = _flat(b.column("hot"))
        asked, hot = (x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (asked, hot))
        for lo, words, rows in hashed_words(b.column("text"), lower=False):
            n_rows = len(rows) - 1
            row, at, size, h = segments(words, rows)

            def among(values: np.ndarray, e: np.ndarray) -> np.ndarray:
                own = np.repeat(np.arange(n_rows), np.diff(e[lo:lo + n_rows + 1])).astype(np.uint64)
                return np.isin(mix(h ^ mix(row.astype(np.uint64))), mix(values[e[lo]:e[lo + n_rows]] ^ mix(own)))

            many = among(hot, hot_ends)
            take = many | among(asked, ends)
            row, at, size, h, many = row[take], at[take], size[take], h[take], many[take]
            times = np.where(many, size, 1)            # single windows, each its own group
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, at, size, h, many = (np.repeat(x, times) for x in (row, at, size, h, many))
            at, size = np.where(many, at + step, at), np.where(many, 1, size)
            start = rows[row] + at
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * _pow(_BASE, len(words))[:len(words)], out=sums[1:])
            c = mix((sums[start + size + LENGTH - 1] - sums[start]) * _pow(_INV, len(words) + 1)[start]
                    + size.astype(np.uint64))
            of = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(np.where(many, c, h))), pa.array(as_long(c)), b.column("id").take(of),
                 b.column("fp").take(of), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int16))],
                names=["g", "c", "id", "fp", "at", "n"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the sequences that a text is asked for."""
    for b in batches:
        flat, ends = _flat(b.column("asked"))
        at, size, g, c = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        for lo, words, rows in hashed_words(b.column("text"), lower=False):
            row = np.repeat(np.arange(len(rows) - 1), np.diff(ends[lo:lo + len(rows)]))
            for s in range(ends[lo], ends[lo + len(rows) - 1], ROWS):
                p = slice(s, min(s + ROWS, ends[lo + len(rows) - 1]))
                of = row[p.start - ends[lo]:p.stop - ends[lo]]
                length = size[p] + LENGTH - 1
                off = np.append(0, np.cumsum(length))
                index = np.arange(off[-1]) + np.repeat(rows[of] + at[p] - off[:-1], length)
                raw = pa.Array.from_buffers(pa.binary(), len(length), [
                    None, pa.py_buffer((off * 8).astype(np.int32)), pa.py_buffer(words[index])])
                yield pa.RecordBatch.from_arrays([pa.array(g[p]), pa.array(c[p]), raw,
                                                  b.column("id").take(pa.array(of + lo))], names=["g", "c", "words", "first"])


class SuffixAutomaton:
    """All substrings of the sequences added so far; states hold their longest length, link and transitions."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, seq: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in seq:
            to = nxt[last].get(w)
            if to is not None and length[to] == length[last] + 1:
                last = to
                continue
            if to is None:
                new = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
                last = new
                if p == -1:
                    continue
                to = nxt[p][w]
                if length[to] == length[p] + 1:
                    link[new] = to
                    continue
            else:
                p, new = last, None
            half = len(nxt)                            # the part of ``to`` that is reached from p
            nxt.append(nxt[to].copy())
            length.append(length[p] + 1)
            link.append(link[to])
            link[to] = half
            if new is None:
                last = half
            else:
                link[new] = half
            while p != -1 and nxt[p].get(w) == to:
                nxt[p][w] = half
                p = link[p]

    def statistics(self, seq: list) -> list[int]:
        """Length of the longest match that ends at each element."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for w in seq:
            to = nxt[state].get(w)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = nxt[state].get(w)
                size = length[state]
                if to is None:
                    out.append(0)
                    continue
            state, size = to, size + 1
            out.append(size)
        return out


def covered(statistics: list[int], least: int = LENGTH) -> int:
    """Bit i is set where a match of ``least`` or more covers element i."""
    bits = 0
    for i, size in enumerate(statistics):
        if size >= least:
            bits |= ((1 << size) - 1) << (i + 1 - size)
    return bits


def stream(shard: list[tuple]) -> Iterator[int]:
    """The covered elements of each (id, sequence), ids ascending, by sequences with smaller ids."""
    automaton, waiting, before = SuffixAutomaton(), [], None
    for i, (key, seq) in enumerate(shard):
        if i and key != before:
            for s in waiting:
                automaton.add(s)
            waiting = []
        before = key
        found = automaton.statistics(seq)
        if found[-1] < len(seq):                       # else it holds it already
            waiting.append(seq)
        yield covered(found)


def _stream_shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """One automaton for consecutive groups of at most ``limit`` words, and the last one's rest."""
    held: list[tuple] = []
    size, group = 0, None

    def flush() -> pa.RecordBatch:
        held.sort(key=lambda x: (x[2] is None, x[2]))
        bits = list(stream([(first, np.frombuffer(words, np.int64).tolist()) for _, words, first in held]))
        return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in held], pa.int64()),
                                           pa.array([first for _, _, first in held], kind),
                                           pa.array(bits, pa.int64())], names=["c", "first", "bits"])

    kind = pa.null()
    for b in batches:
        kind = b.schema.field("first").type
        for g, c, words, first in zip(*(b.column(x).to_pylist() for x in ("g", "c", "words", "first"))):
            if g != group and size >= limit:
                yield flush()
                held, size = [], 0
            group = g
            held.append((c, words, first))
            size += len(words) // 8
    if held:
        yield flush()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept words of every text, joined by one space, and the numbers of words and of removed ones."""
    for b in batches:
        data, off = utf8_view(b.column("text"))
        flat, ends = _flat(b.column("spans"))
        at, bits = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        kept, n_words, n_removed = [], [], []
        for lo, hi in pieces(off):
            part = data[off[lo]:off[hi]]
            starts, stops, rows = word_bounds(part, off[lo:hi + 1] - off[lo])
            gone = np.zeros(len(starts) + 64, bool)
            own = slice(ends[lo], ends[hi])
            base = np.repeat(rows[:-1], np.diff(ends[lo:hi + 1])) + at[own]
            for j in range(64):
                hit = (bits[own] >> j) & 1 == 1
                gone[base[hit] + j] = True
            gone = gone[:len(starts)]
            left = np.append(0, np.cumsum(~gone))
            first = np.zeros(len(starts), bool)        # the first kept word of its row has no space before it
            live = np.flatnonzero(~gone)
            at_row = left[rows[:-1]]
            first[live[at_row[at_row < left[rows[1:]]]]] = True
            s, e = starts[live] - ~first[live], stops[live]
            edge = np.zeros(len(part) + 1, np.int32)
            edge[s] += 1
            edge[e] -= 1
            take = np.cumsum(edge[:-1]) > 0
            text = np.where(_SPACE[part], np.uint8(32), part)[take]
            size = np.append(0, np.cumsum(take))[off[lo:hi + 1] - off[lo]]
            kept.append(pa.Array.from_buffers(pa.large_string(), hi - lo, [
                None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))]))
            n_words.append(np.diff(rows))
            n_removed.append(np.diff(np.append(0, np.cumsum(gone))[rows]))
        if kept:
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.concat_arrays(kept).cast(pa.string()), pa.array(np.concatenate(n_words)),
                 pa.array(np.concatenate(n_removed))], names=["id", "kept", "n_words", "n_removed"])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(key, kept, n_words, n_removed) of every row: the text without repeats, words joined by one space."""
    d = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("fp", F.xxhash64("text"))
    kind = d.schema["id"].dataType.simpleString()
    folder = work_folder(docs.sparkSession, "automata")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df = write_table(df, folder, name)
        release(docs.sparkSession)
        return df

    def of_text(right: DataFrame, how: str) -> DataFrame:
        r = right.withColumnsRenamed({"fp": "fp_", "id": "id_"})
        return d.join(r, (F.col("fp") == F.col("fp_")) & null_safe(F.col("id"), F.col("id_")), how).drop("fp_", "id_")

    found = d.mapInArrow(_find, f"id {kind}, fp bigint, h bigint")
    keys = stored(_repeated(found, hot), "anchors")    # stored, so that the join's hot keys can be split
    asked = stored(found.join(keys, "h").groupBy("fp", "id")
                   .agg(F.collect_set(F.expr("CASE WHEN NOT hot THEN h END")).alias("asked"),
                        F.collect_set(F.expr("CASE WHEN hot THEN h END")).alias("hot")), "asked")
    seen = stored(of_text(asked, "inner").select("id", "fp", "text", "asked", "hot")
                  .mapInArrow(_read, f"g bigint, c bigint, id {kind}, fp bigint, at int, n smallint"), "segments")
    first = F.min(F.struct(F.col("id").isNull(), "id", "fp", "at")).alias("one")
    distinct = seen.groupBy("g", "c").agg(first, F.max("n").alias("n"))
    distinct = stored(distinct.select("g", "c", "n", "one.id", "one.fp", "one.at",
                                      F.count("*").over(Window.partitionBy("g")).alias("k")), "sequences")
    asked = distinct.where("k > 1").groupBy("fp", "id").agg(F.collect_list(F.struct("at", "n", "g", "c")).alias("asked"))
    words = (of_text(asked, "inner").select("id", "text", "asked")
             .mapInArrow(_words, f"g bigint, c bigint, words binary, first {kind}"))
    matched = stored(words.repartition("g").sortWithinPartitions("g")
                     .mapInArrow(partial(_stream_shards, limit=shard), f"c bigint, first {kind}, bits bigint"), "matches")
    alone = distinct.where("k = 1").select("c", F.col("id").alias("first"), F.lit(0).cast("bigint").alias("bits"))
    whole = F.expr(f"shiftleft(1L, n + {LENGTH - 1}) - 1L")
    spans = (seen.join(matched.union(alone), "c")
             .select("id", "fp", "at", F.when(null_safe(F.col("id"), F.col("first")), F.col("bits"))
                     .otherwise(whole).alias("bits"))
             .where("bits <> 0").groupBy("fp", "id").agg(F.collect_set(F.struct("at", "bits")).alias("spans")))
    return (of_text(spans, "left").select("id", "text", "spans")
            .mapInArrow(_remove, f"id {kind}, kept string, n_words bigint, n_removed bigint")
            .withColumnRenamed("id", "key"))


def _repeated(found: DataFrame, hot: int) -> DataFrame:
    """(h, hot): the anchors that two ids have, and whether more than ``hot`` rows do."""
    keys = found.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c"),
                                  F.count("id").alias("known"))
    return (keys.where((F.col("lo") < F.col("hi")) | (F.col("lo").isNotNull() & (F.col("known") < F.col("c"))))
            .select("h", (F.col("c") > hot).alias("hot")))
