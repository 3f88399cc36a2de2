"""Line dedup by repeated runs of lines.

A passage is a run of lines that begins and ends at a line with a word and has
at least two of them, or one line of more than ``LONG_LINE`` words.  Every line
of a passage that occurs, byte for byte, at an earlier place of the corpus too
(an earlier document, or earlier in its own) is removed.

A repeated run of lines is the union of the repeated pairs of neighbouring
lines with words in it, so the rolling hash over two lines (with what stands
between them) taken at every line, and that of every long line, finds runs of
any length with both their ends; no chunk boundary has to fall into them.

Hashes only name candidates: narrow rows (no text) are shuffled and grouped
to find hashes that occur twice; the texts of those pairs and lines are then
grouped by their bytes.  The first place of every line's bytes always stays.

Places are ordered by (key, text hash, line), null keys last.  Rows equal in
key and text are one document here and share its result.  Lines without a word
go with the line before them, at the start of a text with the one after.  Null
texts stay null, empty texts empty.  A text of which every line goes becomes
empty; the row stays.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souq.llm.common import (as_long, fresh_name, null_safe, pieces, span_hashes, utf8_view, word_bounds, work_folder,
                             write_table)

LONG_LINE = 50


def line_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of neighbouring lines with words, and long lines, of the rows of a text column.

    Returns, for every one: its row, first byte, end byte (without the line
    feed), number in its row, and the first line and lines that go with it.
    """
    n_rows = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    # a line starts at its row's start and after every line feed (also one that ends the row)
    row_of_feed = np.searchsorted(offsets, feeds, side="right") - 1
    starts = np.concatenate([offsets[:-1], feeds + 1])
    rows = np.concatenate([np.arange(n_rows), row_of_feed])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    last_of_row = np.append(rows[1:] != rows[:-1], True)
    ends = np.where(last_of_row, offsets[rows + 1], np.append(starts[1:], 0) - 1)
    line = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n_rows))[rows]
    word_starts = word_bounds(data, offsets)[0]
    words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    solid = np.flatnonzero(words)
    r, at = rows[solid], line[solid]
    joined = np.append(r[1:] == r[:-1], False)[:len(r)]              # the next line with words is of the same row
    leads = np.append(True, ~joined[:-1])[:len(r)]
    n_lines = np.bincount(rows, minlength=n_rows)
    low = np.where(leads, 0, at)
    high = np.where(joined, np.append(at[1:], 0)[:len(at)], n_lines[r])
    pair, alone = np.flatnonzero(joined), np.flatnonzero(words[solid] > LONG_LINE)
    first, last = np.concatenate([pair, alone]), np.concatenate([pair + 1, alone])
    no = 2 * at[first] + (first == last)
    return r[first], starts[solid[first]], ends[solid[last]], no, low[first], high[last] - low[first]


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = utf8_view(b.column("text"))
        for lo, hi in pieces(off):
            part = data[off[lo]:off[hi]]
            row, start, end, no, _, _ = line_units(part, off[lo:hi + 1] - off[lo])
            at = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(at), b.column("th").take(at), pa.array(no.astype(np.int32)),
                 pa.array(as_long(span_hashes(part, start, end)))], names=["key", "th", "no", "h"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the units that the column ``wanted`` lists."""
    for b in batches:
        data, off = utf8_view(b.column("text"))
        for lo, hi in pieces(off):
            part = data[off[lo]:off[hi]]
            row, start, end, no, line, lines = line_units(part, off[lo:hi + 1] - off[lo])
            wanted = b.column("wanted").slice(lo, hi - lo)
            listed = (pc.list_parent_indices(wanted).to_numpy().astype(np.int64) << 32) + \
                pc.list_flatten(wanted).to_numpy().astype(np.int64)
            many = np.flatnonzero(np.isin((row.astype(np.int64) << 32) + no, listed))
            at = pa.array(row[many] + lo)
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(at), b.column("th").take(at), pa.array(no[many].astype(np.int32)),
                 pa.array(line[many].astype(np.int32)), pa.array(lines[many].astype(np.int32)),
                 pa.array(as_long(span_hashes(part, start[many], end[many]))),
                 pa.array([part[s:e].tobytes() for s, e in zip(start[many], end[many])], pa.binary())],
                names=["key", "th", "no", "line", "lines", "h", "passage"])


def removals(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, th, removed): the (line, lines) of the passages to remove from every document that has any."""
    d = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("th"),
                    F.col(f"`{text}`").alias("text")).where("text is not null")
    kind = d.schema["key"].dataType.simpleString()
    units = write_table(d.mapInArrow(_narrow, f"key {kind}, th bigint, no int, h bigint"), folder, "units")
    twice = write_table(units.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
                        .select(F.col("h").alias("h2")), folder, "twice")
    # one row per document; a document's own lines bound the list
    named = units.join(twice.hint("merge"), F.col("h") == F.col("h2"), "left_semi") \
        .groupBy(F.col("key").alias("key2"), F.col("th").alias("th2")).agg(F.collect_set("no").alias("wanted"))
    texts = d.join(named.hint("merge"), null_safe(F.col("key"), F.col("key2")) & (F.col("th") == F.col("th2"))) \
        .select("key", "th", "text", "wanted")
    texts = write_table(texts.mapInArrow(_texts, f"key {kind}, th bigint, no int, line int, lines int, h bigint, "
                                                 "passage binary"), folder, "candidates")
    place = F.struct(F.col("key").isNull().alias("last"), "key", "th", "no")
    first = texts.groupBy("h", "passage").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("h").alias("h2"), F.col("passage").alias("passage2"), "first")
    gone = texts.join(first, (F.col("h") == F.col("h2")) & (F.col("passage") == F.col("passage2"))) \
        .where(~null_safe(place, F.col("first")))
    return gone.groupBy("key", "th").agg(F.sort_array(F.collect_set(F.struct("line", "lines"))).alias("removed"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars",
          removed_lines: str | None = None) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; ``n_chars`` follows, if it is there.

    ``removed_lines`` names a further column for the number of lines removed.
    """
    folder = work_folder(docs.sparkSession, "lines")
    gone = write_table(removals(docs, folder, key, text), folder, "removals")
    k, t, r = (fresh_name(docs, x) for x in ("line_key", "line_th", "line_removed"))
    gone = gone.select(F.col("key").alias(k), F.col("th").alias(t), F.col("removed").alias(r))
    # one plan at every size: the list of removals grows with the corpus and is never broadcast
    out = docs.join(gone.hint("merge"), null_safe(F.col(f"`{key}`"), F.col(k))
                    & (F.xxhash64(f"`{text}`") == F.col(t)), "left")
    lines = F.split(F.col(f"`{text}`"), "\n")
    drop = F.flatten(F.transform(F.col(r), lambda c: F.sequence(c["line"], c["line"] + c["lines"] - 1)))    # may overlap
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    cleaned = F.when(F.col(r).isNull(), F.col(f"`{text}`")).otherwise(
        bind(lines, lambda x: F.array_join(F.transform(keep, lambda i: F.get(x, i)), "\n")))
    new = fresh_name(docs, "line_text")
    out = out.withColumn(new, cleaned)
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(F.col(new).alias(c))
        elif n_chars and c == n_chars:
            cols.append(F.when(F.col(r).isNull(), F.col(f"`{c}`")).otherwise(
                F.length(new).cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    if removed_lines:
        cols.append(F.when(F.col(r).isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(drop))).cast("bigint")
                    .alias(removed_lines))
    return out.select(*cols)
