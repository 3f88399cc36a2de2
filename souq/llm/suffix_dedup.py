"""Repeated byte strings found with suffix arrays by linear grouping.

Every byte that a string of ``LENGTH`` bytes covers which also starts anywhere
else (in any text, the same one included) is removed.  Strings are judged on
the input; matches never cross texts.

* Anchors.  Every string of LENGTH bytes contains LENGTH - GRAM + 1 grams of
  GRAM bytes; its anchor is the first smallest of their hashes.  Equal strings
  have equal anchors at equal offsets, so a string can only repeat where its
  anchor's gram does.  Anchors are narrow rows (about one for 100 bytes), and
  only those whose hash occurs twice go on.
* Contexts.  All strings of an anchor lie within the LENGTH - GRAM bytes
  before and after its gram.  Equal contexts are counted together before
  anything is gathered.  An anchor with one distinct context needs no search:
  every string in it repeats (that is what exact copies and long repeats
  come down to).
* Suffix arrays.  The distinct contexts of each other anchor become a
  sequence of phrases (cut at word starts chosen by their bytes) with a
  sentinel after each.  Its suffix array, built by linear grouping, and the
  common prefixes of neighbours give the longest run of phrases that every
  context shares with another; contexts whose run, with the phrases around
  it, is shorter than LENGTH are out.  The others' strings are compared
  exactly by the hashes of all their LENGTH-byte windows.
* Anchors with more than ``BIG`` distinct contexts are not gathered: their
  windows are rows, counted by hash in Spark.

Null texts are empty: nothing is removed, and the digest is the empty one's.
Rows equal in key and text both count as occurrences and share a result.
Texts shorter than LENGTH keep all bytes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souq.llm.common import (_BASE, _INV, _SPACE, _pow, as_long, mix, null_safe, pieces, utf8_view, work_folder,
                             write_table)
from souq.llm.suffix_groups import common_prefixes, suffix_array

LENGTH = 400
GRAM = 200
SIDE = LENGTH - GRAM
BIG = 20_000
PIECE = 1 << 19


def _sums(data: np.ndarray) -> np.ndarray:
    n = len(data)
    out = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _pow(_BASE, n)[:n], out=out[1:])
    return out


def _span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) from prefix sums."""
    return mix((sums[ends] - sums[starts]) * _pow(_INV, len(sums))[starts])


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(h)
    pad = (-n) % w
    x = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, position in the row, gram hash, context hash, bytes before, bytes after) of all anchors of a piece."""
    rows, at = [], []
    sums = _sums(data)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    if not len(long):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64), np.zeros(0, np.uint64), e, e
    starts = np.arange(len(data) - GRAM + 1)
    h = _span(sums, starts, starts + GRAM)
    for r in long:
        a, b = offsets[r], offsets[r + 1]
        own = h[a:b - GRAM + 1]
        low = _window_min(own, SIDE + 1)
        # position j is the first smallest of some window: the first such window starts after the last equal or
        # smaller gram before j; it must end at the text's end or before a smaller gram
        hit = np.zeros(len(own), dtype=bool)
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        last = np.append(first[1:], len(low)) - 1
        for i, j in zip(first, last):                # windows i..j have the same minimum
            p = np.flatnonzero(own[i:j + SIDE + 1] == low[i]) + i
            if len(p) == 1:
                hit[p[0]] = True
            else:                                    # the first one at or after each window's start
                hit[p[np.unique(np.searchsorted(p, np.arange(i, j + 1)))]] = True
        p = np.flatnonzero(hit)
        rows.append(np.full(len(p), r))
        at.append(p)
    rows, at = np.concatenate(rows), np.concatenate(at)
    size = offsets[rows + 1] - offsets[rows]
    before, after = np.minimum(at, SIDE), np.minimum(size - at - GRAM, SIDE)
    pos = offsets[rows] + at
    ctx = mix(_span(sums, pos - before, pos + GRAM + after) + before.astype(np.uint64))
    return rows, at, h[pos], ctx, before, after


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = utf8_view(b.column("text"))
        for lo, hi in pieces(off, PIECE):
            rows, at, h, ctx, before, after = anchors(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            take = pa.array(rows + lo)
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(take), b.column("th").take(take), pa.array(at.astype(np.int64)),
                 pa.array(as_long(h)), pa.array(as_long(ctx)), pa.array(before.astype(np.int16)),
                 pa.array(after.astype(np.int16))], names=["key", "th", "pos", "h", "ctx", "before", "after"])


def _read_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that are asked of every text."""
    for b in batches:
        data, off = utf8_view(b.column("text"))
        out: list[tuple] = []
        for i, asked in enumerate(b.column("asked")):
            a = off[i]
            for x in asked.as_py() or ():
                out.append((x["h"], x["ctx"], x["before"],
                            data[a + x["pos"] - x["before"]:a + x["pos"] + GRAM + x["after"]].tobytes()))
            if len(out) > 4000:
                yield _contexts(out)
                out = []
        if out:
            yield _contexts(out)


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    h, ctx, before, raw = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(ctx, pa.int64()),
                                       pa.array(before, pa.int16()), pa.array(raw, pa.binary())],
                                      names=["h", "ctx", "before", "bytes"])


def phrases(raw: bytes) -> list[int]:
    """Starts of the phrases of a context, its first byte included: word starts chosen by their own two bytes."""
    d = np.frombuffer(raw, np.uint8)
    s = _SPACE[d]
    at = np.flatnonzero(s[:-1] & ~s[1:]) + 1
    at = at[at < len(d) - 1]
    pick = (d[at].astype(np.int64) * 31 + d[at + 1].astype(np.int64) * 17) & 7 < 2
    return [0, *at[pick].tolist()]


def worth_comparing(contexts: list[bytes]) -> list[bool]:
    """Which contexts may have a LENGTH-byte string in common with another, by their phrases' suffix array."""
    ids: dict[bytes, int] = {}
    symbols: list[int] = []
    owner: list[int] = []
    size: list[int] = []
    n = len(contexts)
    keep = [False] * n
    for i, raw in enumerate(contexts):
        cut = [*phrases(raw), len(raw)]
        if max(b - a for a, b in zip(cut, cut[1:])) >= LENGTH:
            keep[i] = True                            # a string may lie within one phrase
        # the first and last pieces are parts of phrases: they match nothing
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            inner = 0 < k < len(cut) - 2
            symbols.append(n + 1 + ids.setdefault(raw[a:b], len(ids)) if inner else 0)
            owner.append(i)
            size.append(b - a)
        symbols.append(0)
        owner.append(i)
        size.append(0)
    fresh = n + 1 + len(ids)
    for k, x in enumerate(symbols):                   # every sentinel and part is a symbol of its own
        if not x:
            symbols[k] = fresh
            fresh += 1
    symbols.append(0)
    owner.append(-1)
    size.append(0)
    order = suffix_array(symbols)
    lcp = common_prefixes(symbols, order) + [0]
    bytes_to = [0]
    for x in size:
        bytes_to.append(bytes_to[-1] + x)
    for r, s in enumerate(order):
        i = owner[s]
        if i < 0 or keep[i]:
            continue
        run = max(lcp[r], lcp[r + 1])
        # a match also reaches into the phrases before and after the run
        lead = size[s - 1] if s and owner[s - 1] == i else 0
        tail = size[s + run] if s + run < len(size) and owner[s + run] == i else 0
        # a cut on a match's last byte depends on the byte after it, so only one of the two texts may have it
        if bytes_to[s + run] - bytes_to[s] + lead + tail >= LENGTH - 1:
            keep[i] = True
    return keep


def _windows(raw: bytes, before: int) -> np.ndarray:
    """Hashes of all windows with their place by the anchor: one place of a text is in several of its contexts."""
    d = np.frombuffer(raw, np.uint8)
    n = len(d) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return mix(_span(_sums(d), at, at + LENGTH) + (at - before).astype(np.uint64))


def repeated_run(contexts: list[bytes], befores: list[int], counts: list[int]) -> list[tuple[int, int] | None]:
    """For every distinct context of one anchor: the byte run covered by strings that another place has too.

    All strings of a context contain its anchor, so what they cover is one run.
    """
    out: list[tuple[int, int] | None] = [None] * len(contexts)
    keep = worth_comparing(contexts)
    chosen = [i for i, k in enumerate(keep) if k or counts[i] > 1]
    if not chosen:
        return out
    hashes = [_windows(contexts[i], befores[i]) for i in chosen]
    flat = np.concatenate(hashes)
    weight = np.repeat([counts[i] for i in chosen], [len(x) for x in hashes])
    _, inverse = np.unique(flat, return_inverse=True)
    twice = np.bincount(inverse, weights=weight)[inverse] > 1 if len(flat) else np.zeros(0, bool)
    lo = 0
    for i, x in zip(chosen, hashes):
        if len(hit := np.flatnonzero(twice[lo:lo + len(x)])):
            out[i] = int(hit[0]), int(hit[-1]) + LENGTH
        lo += len(x)
    return out


MARKS = "h bigint, ctx bigint, a int, b int"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs, relative to the anchor, of the contexts of each anchor; input sorted by anchor."""
    held: list[dict] = []

    def flush(rows: list[dict]) -> list[tuple]:
        runs = repeated_run([r["bytes"] for r in rows], [r["before"] for r in rows], [r["n"] for r in rows])
        return [(r["h"], r["ctx"], s[0] - r["before"], s[1] - r["before"]) for r, s in zip(rows, runs) if s]
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            if held and held[0]["h"] != r["h"]:
                out += flush(held)
                held = []
            held.append(r)
        yield _marks(out)
    if held:
        yield _marks(flush(held))


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"h": pa.int64(), "ctx": pa.int64(), "a": pa.int32(), "b": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())],
                                      names=list(kinds))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            w = _windows(r["bytes"], r["before"])
            k = len(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["h"]] * k, pa.int64()), pa.array([r["ctx"]] * k, pa.int64()),
                 pa.array(np.arange(k, dtype=np.int32) - r["before"]), pa.array(as_long(w)),
                 pa.array([r["n"]] * k, pa.int64())], names=["h", "ctx", "a", "w", "n"])


def spans(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, th, spans): for every text with repeats, byte runs [a, b) that may overlap."""
    d = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("th"),
                    F.col(f"`{text}`").alias("text")).where(F.octet_length("text") >= LENGTH)
    kind = dict(d.dtypes)["key"]
    all_ = write_table(d.mapInArrow(_find_anchors, f"key {kind}, th bigint, pos bigint, h bigint, ctx bigint, "
                                                   "before smallint, after smallint"), folder, "anchors")
    twice = write_table(all_.groupBy(F.col("h").alias("h2")).agg(F.count("*").alias("k")).where("k > 1").select("h2"),
                        folder, "twice")
    sites = write_table(all_.join(twice, F.col("h") == F.col("h2"), "left_semi"), folder, "sites")
    one = sites.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("key", "th", "pos", "before", "after"))
                                        .alias("at"))
    one = write_table(one, folder, "contexts")
    kinds = one.groupBy(F.col("h").alias("h2")).agg(F.count("*").alias("kinds"))
    one = one.join(kinds, F.col("h") == F.col("h2"))
    whole = one.where("kinds = 1").select(
        "h", "ctx", (-F.col("at.before")).cast("int").alias("a"), (F.col("at.after") + GRAM).cast("int").alias("b"))
    # the bytes of each distinct context are read from one text that has it
    mixed = write_table(one.where("kinds > 1").select("h", "ctx", "n", "kinds", "at"), folder, "mixed")
    asked = mixed.groupBy(F.col("at.key").alias("k"), F.col("at.th").alias("t")).agg(F.collect_list(F.struct(
        "h", "ctx", F.col("at.pos").alias("pos"), F.col("at.before").alias("before"), F.col("at.after").alias("after")))
        .alias("asked"))
    texts = d.join(asked, null_safe(F.col("key"), F.col("k")) & (F.col("th") == F.col("t"))).select("text", "asked")
    raw = texts.mapInArrow(_read_contexts, "h bigint, ctx bigint, before smallint, bytes binary")
    # rows equal in key and text answer twice: one is enough
    raw = raw.dropDuplicates(["h", "ctx"]).join(
        mixed.select(F.col("h").alias("h2"), F.col("ctx").alias("c2"), "n", "kinds"),
        (F.col("h") == F.col("h2")) & (F.col("ctx") == F.col("c2"))).select("h", "ctx", "before", "bytes", "n", "kinds")
    raw = write_table(raw, folder, "bytes")
    small = raw.where(F.col("kinds") <= BIG).drop("kinds").repartition("h").sortWithinPartitions("h", "ctx")
    found = small.mapInArrow(_mark, MARKS)
    many = raw.where(F.col("kinds") > BIG).drop("kinds").mapInArrow(
        _window_rows, "h bigint, ctx bigint, a int, w bigint, n bigint")
    again = many.groupBy(F.col("w").alias("w2")).agg(F.sum("n").alias("k")).where("k > 1").select("w2")
    many = many.join(again, F.col("w") == F.col("w2"), "left_semi").groupBy("h", "ctx").agg(
        F.min("a").alias("a"), (F.max("a") + LENGTH).cast("int").alias("b"))
    marks = write_table(whole.unionByName(found).unionByName(many), folder, "marks")
    marks = marks.select(F.col("h").alias("h2"), F.col("ctx").alias("c2"), "a", "b")
    own = sites.join(marks, (F.col("h") == F.col("h2")) & (F.col("ctx") == F.col("c2")))
    own = own.select("key", "th", F.struct((F.col("a") + F.col("pos")).alias("a"), (F.col("b") + F.col("pos")).alias("b"))
                     .alias("s"))
    # bounded by the text itself: about one anchor for 100 bytes
    return own.groupBy("key", "th").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the runs of every text: sizes, digest and what is left."""
    for b in batches:
        data, off = utf8_view(b.column("text"))
        rows = []
        for i, spans_ in enumerate(b.column("spans")):
            own = data[off[i]:off[i + 1]]
            merged: list[list[int]] = []
            for s in spans_.as_py() or ():
                if merged and s["a"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["b"])
                else:
                    merged.append([s["a"], s["b"]])
            left, at = [], 0
            for a, z in merged:
                left.append(own[at:a].tobytes())
                at = z
            left.append(own[at:].tobytes())
            left = b"".join(left)
            rows.append((len(own), len(own) - len(left), len(merged), hashlib.sha256(left).hexdigest()))
        n, gone, runs, digest = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
             pa.array(digest, pa.string())], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    folder = work_folder(docs.sparkSession, "repeats")
    found = write_table(spans(docs, folder, key, text), folder, "spans")
    d = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("th"), F.col(f"`{text}`").alias("text"))
    x = d.join(found.select(F.col("key").alias("k"), F.col("th").alias("t"), "spans"),
               null_safe(F.col("key"), F.col("k")) & (F.col("th") == F.col("t")), "left")
    kind = dict(d.dtypes)["key"]
    return x.select("key", "text", "spans").mapInArrow(
        _cut, f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
