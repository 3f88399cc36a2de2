"""N-gram Jaccard join with several global token orders.

A text's set is its distinct 5-word shingles (A-Z lower-cased; with fewer
words the whole sequence is one shingle; without words the set is empty and
linked with nothing).  Two texts link when 100 * |intersection| >= 80 *
|union|.  Two texts of sizes x and y that link have at least ceil(0.8 max(x, y))
shingles in common.  Two global orders of all shingles filter candidates:

* First order, by hash: a set's *window* is its first prefix_length(n) + room
  shingles.  The windows of two linked sets have at least ``needed(n)``
  shingles in common (with a room of 0 that is the usual prefix filter's one).
* Second order, by the number of windows a shingle is in, rare ones first:
  the rarest shingle that both windows have stands among the first
  |window| - needed(n) + 1 of each window in this order.  So linked sets share a
  shingle of these prefixes, and a set with fewer than needed(n) shingles
  in its window that any other window has needs none: it has no partner.
* A set's *parities* say for each of ``PARITIES`` hash buckets whether it has an
  odd number of shingles there.  Two sets differ in at least as many shingles as
  their parities differ in buckets, and linked sets of x and y differ in at most
  (x + y) / 9 shingles, so pairs that differ in more buckets are not linked;
  these few bytes are compared before any whole set is fetched.
* Pairs must further share a prefix shingle under ``ORDERS`` - 2 more orders
  (by other hashes) and have sizes that fit, before they are verified exactly
  on whole sets.

Texts of equal sets are one node from the start (the smallest id labels it).
Every node's first candidate pair is verified first; of the others, only those
whose nodes are still in different components.
A shingle in more than ``BIG`` prefixes belongs to a large group of near
copies.  The members of such groups get new prefixes from their whole sets,
rarest first among themselves, and are tied to a few members each (some pairs
per member, not one per pair of members), in turns while that joins
components; then only pairs of *different* components that share such a
shingle are left, and all of those are tried.  No pair is dropped: a pair
inside a component cannot change it.

Result: every row with its set size and its component, named by the smallest
id that links reach.  Null texts count as empty.  Rows without an id get a
size, and the component of the texts they equal or link to (null if none has
an id).  Rows of one id but different texts are separate texts that carry the
same id.  Empty sets are their own component.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souq.llm.common import (as_long, components, drop_table, fresh_name, hashed_words, mix, null_safe, release,
                             work_folder, write_table)

SHINGLE = 5
PERCENT = 80
ORDERS = 3
BIG = 32
TIES = 4
ROOM = 32
PARITIES = 1024
_SALTS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_MULT = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def window_length(n: int) -> int:
    p = prefix_length(n)
    return min(n, p + p // 4 + ROOM)


def needed(n: int) -> int:
    """Shingles that the windows of a set of n and any set it links with have in common, at least.

    Linked sets of x and y have x - prefix_length(x) + 1 or more shingles in
    common, so the first window_length - prefix_length + 1 of these stand in
    the window; the smallest fitting partner has the smallest window.
    """
    m = -(-PERCENT * n // 100)
    return window_length(m) - prefix_length(m) + 1


def shingle_sets(column) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row of an Arrow text column."""
    for lo, h, rows in hashed_words(column):
        five = np.zeros(0, np.uint64)
        if len(h) >= SHINGLE:
            five = h[:len(h) - SHINGLE + 1].copy()
            for j in range(1, SHINGLE):
                five = five * _MULT[0] + h[j:len(h) - SHINGLE + 1 + j]
            five = mix(five)
        for i in range(len(rows) - 1):
            a, b = rows[i], rows[i + 1]
            if b - a >= SHINGLE:
                yield lo + i, np.unique(five[a:b - SHINGLE + 1])
            elif b > a:                               # a short text's one shingle: no five-word one equals it
                x = h[a:a + 1] * _MULT[1] + np.uint64(b - a)
                for w in range(a + 1, b):
                    x = x * _MULT[1] + h[w:w + 1]
                yield lo + i, mix(x)
            else:
                yield lo + i, np.zeros(0, np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    at = np.cumsum([0] + [len(p) for p in parts])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(as_long(flat)))


def parities(t: np.ndarray) -> np.ndarray:
    """64 buckets in each of PARITIES // 64 numbers: the bit is 1 if an odd number of the shingles is there."""
    odd = np.bincount((mix(t ^ _SALTS[2]) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, two fingerprints of the set, what its windows need in common, its parities and the window."""
    for b in batches:
        take, n, fa, fb, odd, win = [], [], [], [], [], []

        def out():
            return pa.RecordBatch.from_arrays(
                [b.column("key").take(pa.array(take, pa.int64())), pa.array(n, pa.int64()),
                 pa.array(np.array(fa, dtype=np.uint64).view(np.int64)),
                 pa.array(np.array(fb, dtype=np.uint64).view(np.int64)),
                 pa.array([needed(x) for x in n], pa.int32()), _lists(odd), _lists(win)],
                names=["key", "n", "fa", "fb", "need", "odd", "win"])
        for i, t in shingle_sets(b.column("text")):
            take.append(i)
            n.append(len(t))
            fa.append(t.sum(dtype=np.uint64))
            fb.append(np.bitwise_xor.reduce(mix(t ^ _SALTS[0])) if len(t) else np.uint64(0))
            odd.append(parities(t))
            win.append(t[:window_length(len(t))])
            if len(take) >= 1000:
                yield out()
                take, n, fa, fb, odd, win = [], [], [], [], [], []
        if take:
            yield out()


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints, the whole set, and its prefixes under the further orders."""
    for b in batches:
        n, fa, fb, whole = [], [], [], []
        pre: list[list] = [[] for _ in range(ORDERS - 2)]

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int64()), pa.array(np.array(fa, dtype=np.uint64).view(np.int64)),
                 pa.array(np.array(fb, dtype=np.uint64).view(np.int64)), _lists(whole), *map(_lists, pre)],
                names=["n", "fa", "fb", "tokens", *[f"pre{k}" for k in range(1, ORDERS - 1)]])
        for _, t in shingle_sets(b.column("text")):
            n.append(len(t))
            fa.append(t.sum(dtype=np.uint64))
            fb.append(np.bitwise_xor.reduce(mix(t ^ _SALTS[0])) if len(t) else np.uint64(0))
            whole.append(t)
            for k in range(1, ORDERS - 1):
                place = mix(t ^ _SALTS[k])
                p = prefix_length(len(t))
                pre[k - 1].append(t[np.argpartition(place, p - 1)[:p]] if p < len(t) else t)
            if len(n) >= 500:
                yield out()
                n, fa, fb, whole = [], [], [], []
                pre = [[] for _ in range(ORDERS - 2)]
        if n:
            yield out()


def _sizes_fit(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


class _Join:
    """The steps of one join; every table named here is written to shared storage."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.spark = docs.sparkSession
        self.folder = work_folder(self.spark, "jaccard")
        self.docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        kind = dict(self.docs.dtypes)["key"]
        rows = self.docs.mapInArrow(_signatures, f"key {kind}, n bigint, fa bigint, fb bigint, need int, "
                                    "odd array<bigint>, win array<bigint>")
        self.windows = self.store(rows.withColumn("row", F.monotonically_increasing_id()), "windows")
        self.rows = self.store(self.windows.drop("odd", "win"), "rows")
        nodes = self.rows.where("n > 0").groupBy("fa", "fb", "n", "need").agg(F.min("key").alias("label"),
                                                                             F.min("row").alias("node"))
        self.nodes = self.store(nodes, "nodes")
        self.odd = self.store(self.windows.join(self.nodes.select("node"), F.col("row") == F.col("node"), "left_semi")
                              .select(F.col("row").alias("node"), "n", "odd"), "odd")

    def store(self, df: DataFrame, name: str, *used: str) -> DataFrame:
        """``df`` written and reread; the ``used`` tables and the shuffles that made it are then deleted."""
        df = write_table(df, self.folder, name)
        for x in used:
            drop_table(self.spark, self.folder, x)
        release(self.spark)
        return df

    def repeated(self, posts: DataFrame, count: str, name: str) -> DataFrame:
        """The postings whose token others have too, with how many do.

        Counted with partial sums and joined back, so a frequent token's postings need not meet in one task.
        """
        n = posts.groupBy(F.col("token").alias("t")).agg(F.count("*").alias(count)).where(F.col(count) > 1)
        n = self.store(n, f"{name}-tokens")
        return posts.join(n.hint("merge"), F.col("token") == F.col("t")).drop("t")

    def prefixes(self) -> tuple[DataFrame, DataFrame]:
        """(small, big): postings (token, node, n) of the second order's prefixes, by the size of their group."""
        # every row's window is counted (any count gives an order); then the nodes' postings go on
        posts = self.windows.select(F.col("row").alias("node"), F.explode("win").alias("token"))
        shared = self.repeated(posts, "c", "window").join(self.nodes.select("node", "n", "need"), "node")
        shared = self.store(shared, "shared", "window-tokens", "windows")
        # shingles of no other window come first in the second order, and cannot be shared
        enough = shared.groupBy(F.col("node").alias("m")).agg(F.count("*").cast("int").alias("have"))
        x = shared.join(enough, F.col("node") == F.col("m")).where("have >= need")
        rank = F.row_number().over(Window.partitionBy("node").orderBy("c", "token"))
        x = x.withColumn("r", rank).where("r <= have - need + 1").select("token", "node", "n")
        x = self.store(x, "prefixes", "shared")
        x = self.store(self.repeated(x, "size", "prefix"), "postings", "prefixes", "prefix-tokens")
        return x.where(F.col("size") <= BIG), x.where(F.col("size") > BIG)

    def whole_sets(self, ids: DataFrame, name: str) -> DataFrame:
        """(node, n, tokens, pre1..) of the nodes in ``ids(node)``: their texts are read again by label."""
        wanted = self.store(self.nodes.select("node", "fa", "fb", "n", "label").join(ids, "node", "left_semi"),
                            f"{name}-wanted")
        labels = wanted.select(F.col("label").alias("w")).distinct()
        texts = self.docs.join(labels, null_safe(F.col("key"), F.col("w")), "left_semi").select("text")
        sets = texts.mapInArrow(_whole_sets, "n bigint, fa bigint, fb bigint, tokens array<bigint>"
                                + "".join(f", pre{k} array<bigint>" for k in range(1, ORDERS - 1)))
        sets = sets.join(wanted.select("node", "fa", "fb", "n"), ["fa", "fb", "n"]).drop("fa", "fb")
        return self.store(sets.dropDuplicates(["node"]), f"{name}-sets", f"{name}-wanted")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose parities leave a link possible."""
        side = lambda c: self.odd.select(F.col("node").alias(f"m{c}"), F.col("n").alias(f"n{c}"),
                                         F.col("odd").alias(f"odd{c}"))
        x = pairs.join(side("a"), F.col("a") == F.col("ma")).join(side("b"), F.col("b") == F.col("mb"))
        differ = F.aggregate(F.zip_with("odda", "oddb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0),
                             lambda s, k: s + k)
        return x.where((100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("na") + F.col("nb"))).select("a", "b")

    def verify(self, pairs: DataFrame, name: str, sets: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) that link, of distinct candidates; ``sets``: whole sets that have all their nodes."""
        pairs = self.store(pairs, f"{name}-candidates")
        used = [f"{name}-candidates"]
        if sets is None:
            sets = self.whole_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), name)
            used.append(f"{name}-sets")
        a = sets.select(*[F.col(c).alias(f"a_{c}") for c in sets.columns])
        b = sets.select(*[F.col(c).alias(f"b_{c}") for c in sets.columns])
        x = pairs.join(b, F.col("b") == F.col("b_node")).join(a, F.col("a") == F.col("a_node"))
        for k in range(1, ORDERS - 1):
            x = x.where(F.arrays_overlap(f"a_pre{k}", f"b_pre{k}"))
        x = x.withColumn("common", F.size(F.array_intersect("a_tokens", "b_tokens")))
        x = x.where(100 * F.col("common") >= PERCENT * (F.col("a_n") + F.col("b_n") - F.col("common")))
        return self.store(x.select("a", "b"), f"{name}-links", *used)

    def components(self) -> DataFrame:
        """(node, comp) of all linked nodes."""
        small, big = self.prefixes()
        x, y = _sides(small)
        pairs = x.join(y, F.col("token") == F.col("token2")).where("node < node2").where(
            _sizes_fit(F.col("n"), F.col("n2"))).select(F.col("node").alias("a"), F.col("node2").alias("b"))
        tried = self.store(pairs.distinct(), "pairs")
        # the texts are read and dealt out by id once for both rounds of these pairs
        open_pairs = self.store(self.likely(tried), "likely")
        sets = self.whole_sets(open_pairs.select(F.col("a").alias("node")).union(open_pairs.select("b")).distinct(), "tried")
        # one pair of every node first: most groups are near copies, and what these links join needs no more pairs
        star = self.store(open_pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "star")
        comps = write_table(components(self.verify(star, "star", sets), self.folder, "star-comps"), self.folder, "components0")
        rest = self.apart(open_pairs.join(star, ["a", "b"], "left_anti"), comps)
        comps = self.joined(comps, self.verify(rest, "small", sets), "comps0")
        drop_table(self.spark, self.folder, "tried-sets")
        h = self.open_groups(big, comps, "open0")
        if not h.limit(1).count():
            return comps
        big, before, turn = self.refined(h), None, 0
        while True:
            h = self.open_groups(big, comps, f"open{turn + 1}")
            left = h.agg(F.countDistinct("comp")).first()[0]
            # go on tying while a turn joins at least a tenth of the open components
            if not left or before is not None and left > 0.9 * before:
                break
            before, turn = left, turn + 1
            more = write_table(self.ties(h, turn).join(tried, ["a", "b"], "left_anti"), self.folder, f"ties{turn}")
            tried = tried.union(more)
            comps = self.joined(comps, self.verify(self.likely(more), f"turn{turn}"), f"comps{turn}")
        if not left:
            return comps
        rest = self.across(h).join(tried, ["a", "b"], "left_anti")
        return self.joined(comps, self.verify(self.likely(rest), "last"), "last-comps")

    def apart(self, pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """The pairs whose nodes are in different components."""
        side = lambda c: comps.select(F.col("node").alias(f"n{c}"), F.col("comp").alias(f"c{c}"))
        x = pairs.join(side("a"), F.col("a") == F.col("na"), "left").join(side("b"), F.col("b") == F.col("nb"), "left")
        return x.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def joined(self, comps: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Components after ``links``: only links between different components, each once, are new edges."""
        side = lambda c: comps.select(F.col("node").alias(f"n{c}"), F.col("comp").alias(f"c{c}"))
        new = links.join(side("a"), F.col("a") == F.col("na"), "left").join(side("b"), F.col("b") == F.col("nb"), "left")
        new = new.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
        stars = comps.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
        return write_table(components(stars.union(new), self.folder, name), self.folder, f"{name}-table")

    def refined(self, h: DataFrame) -> DataFrame:
        """Postings (token, node, n, left) of the open nodes again, their windows now their whole sets.

        ``left`` counts the node's shared shingles from this one on in the second order.

        The second order counts the open nodes' sets only, so shingles that a
        copy does not share with the other members come first: a member whose
        own changes are more than the similarity allows has no posting left.
        """
        sets = self.whole_sets(h.select("node").distinct(), "open")
        posts = sets.select("node", "n", F.explode("tokens").alias("token"))
        shared = self.store(self.repeated(posts, "c", "open"), "open-shared", "open-sets", "open-tokens")
        need = F.ceil(F.col("n") * PERCENT / 100)
        enough = shared.groupBy(F.col("node").alias("m")).agg(F.count("*").cast("int").alias("have"))
        x = shared.join(enough, F.col("node") == F.col("m")).where(F.col("have") >= need)
        rank = F.row_number().over(Window.partitionBy("node").orderBy("c", "token"))
        x = x.withColumn("left", F.col("have") - rank + 1).where(F.col("left") >= need)
        return self.store(x.select("token", "node", "n", "left"), "open-postings", "open-shared")

    def open_groups(self, big: DataFrame, comps: DataFrame, name: str) -> DataFrame:
        """Postings (with their component) of the large groups that have more than one component."""
        h = big.join(comps.withColumnRenamed("node", "cn"), F.col("node") == F.col("cn"), "left").select(
            *big.columns, F.coalesce("comp", "node").alias("comp"))
        mixed = h.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        return write_table(h.join(mixed.select("token"), "token", "left_semi"), self.folder, name)

    def ties(self, h: DataFrame, turn: int) -> DataFrame:
        """Pairs of every member of an open group with its TIES nodes that come first by this turn's hash.

        All groups use the same hash, so groups with the same members choose the same nodes.
        """
        pick = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("node", F.lit(turn)), "node"))
        to = h.withColumn("r", pick).where(F.col("r") <= TIES).select(
            F.col("token").alias("t2"), F.col("node").alias("node2"), F.col("n").alias("n2"),
            F.col("left").alias("left2"), F.col("comp").alias("comp2"))
        x = h.join(to, (F.col("token") == F.col("t2")) & (F.col("comp") != F.col("comp2")) & _can_link())
        return x.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()

    def across(self, h: DataFrame) -> DataFrame:
        """All pairs of different components that share a shingle of a large group."""
        y = h.select(F.col("token").alias("t2"), F.col("node").alias("node2"), F.col("n").alias("n2"),
                     F.col("left").alias("left2"), F.col("comp").alias("comp2"))
        x = h.join(y, (F.col("token") == F.col("t2")) & (F.col("comp") < F.col("comp2")) & _can_link())
        return x.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _can_link() -> Column:
    """Sizes fit, and the shingles left from the shared one on suffice for the overlap.

    Linked sets of n and n2 have at least 4 (n + n2) / 9 shingles in common
    (at 80 percent); at their first common one in the second order, all of
    these are still left on both sides, so no linked pair fails everywhere.
    """
    enough = (100 + PERCENT) * F.least("left", "left2") >= PERCENT * (F.col("n") + F.col("n2"))
    return _sizes_fit(F.col("n"), F.col("n2")) & enough


def _sides(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return posts, posts.select(F.col("token").alias("token2"), F.col("node").alias("node2"), F.col("n").alias("n2"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component) for every row of ``docs``."""
    j = _Join(docs, key, text)
    comps = j.components()
    named = j.nodes.select("fa", "fb", "n", "node", "label").join(
        comps.withColumnRenamed("node", "cn"), F.col("node") == F.col("cn"), "left")
    named = write_table(named.select("fa", "fb", "n", "label", F.coalesce("comp", "node").alias("comp")),
                        j.folder, "named")
    names = named.groupBy(F.col("comp").alias("c")).agg(F.min("label").alias("component"))
    named = named.join(names, F.col("comp") == F.col("c")).select("fa", "fb", F.col("n").alias("m"), "component")
    r = j.rows.select("key", "n", F.col("fa").alias("ra"), F.col("fb").alias("rb"))
    out = r.join(named, (F.col("ra") == F.col("fa")) & (F.col("rb") == F.col("fb")) & (F.col("n") == F.col("m")), "left")
    return out.select("key", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("key")).otherwise(
        F.col("component")).alias("component"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component: the one with its smallest id; same columns as ``docs``.

    Texts without words stay, once for every id.  Of several rows with the
    kept id, the one with the smallest text hash stays, once; components
    without any id keep their rows.
    """
    found = near_duplicates(docs, key, text)
    best = found.where("key = component").select("key").distinct()
    k, h, one = (fresh_name(docs, x) for x in ("near_key", "near_hash", "near_row"))
    best = best.select(F.col("key").alias(k))
    kept = docs.join(best, F.col(f"`{key}`") == F.col(k), "left_semi")
    orphan = docs.where(F.col(f"`{key}`").isNull())
    folder = work_folder(docs.sparkSession, "near")
    # ids are rarely repeated: only the repeated ones are compared, on narrow rows
    many = write_table(kept.groupBy(F.col(f"`{key}`").alias(k)).agg(
        F.count("*").alias(one), F.min(F.xxhash64(f"`{text}`")).alias(h)).where(F.col(one) > 1), folder, "repeated")
    kept = kept.join(many, F.col(f"`{key}`") == F.col(k), "left")
    single = kept.where(F.col(k).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    first = kept.where(F.col(k).isNotNull() & (F.coalesce(F.xxhash64(f"`{text}`"), F.lit(0)) == F.coalesce(h, F.lit(0))))
    first = first.dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return single.unionAll(first).unionAll(orphan)
