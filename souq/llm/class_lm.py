"""LM scoring with a Brown class-based bigram model.

Words are put into classes by the exchange algorithm, and a text's
probability is a product over its tokens of P(class | class before) and
P(word | class), both smoothed.  Tokens are lower-cased (A-Z) words and one
end token for each text; the end token also stands before the first word.

Statistics cover all training texts:

* every word's count (by 64-bit word hash), in Spark;
* a start: the bigram counts of the ``CLUSTERED`` most frequent words are summed
  in Spark by blocks of rows and clustered by exchange, one word at a time;
* ``ROUNDS`` rounds in Spark over every word of at least ``MIN_COUNT``
  occurrences, whatever its rank: the classes of its neighbours on both sides
  are summed over all texts, and it goes to the class that makes these most
  likely, given the class counts of the round before.  Words of fewer
  occurrences are too rare to cluster; they and unknown words share one class;
* class transitions over all training tokens, with the classes so found.

The ``KNOWN`` most frequent words are broadcast with their counts and classes,
as most tokens are among them; the others get theirs through joins on the word,
with the same result, so neither memory nor a word's class depends on the rank.

Null and empty texts have the end token alone.  Without training texts all
counts are 0 and the class model is uniform.  Repeated rows are scored alike;
rows need no id, but without one a row is in training only if the hash of the
text "null" says so.  Equal counts order by word hash.  Other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souq.llm.common import as_long, drop_table, hashed_words, release, span_hashes, work_folder, write_table

CLASSES = 64
CLUSTERED = 4096
KNOWN = 1 << 19
MIN_COUNT = 2
ROUNDS = 2
PASSES = 6
ALPHA = 0.5                          # added to word counts, as in the base score
PRIOR = 0.1                          # pseudo-counts of a class transition, shared by class frequency
ROW_BLOCK = 64                       # rows of the bigram matrix in one message
END_CLASS = CLASSES - 1              # the end token has a class of its own
RARE = CLASSES                       # class of the words below MIN_COUNT and of unknown ones
K = CLASSES + 1
TAIL = 255                           # stands for the class of a word that is not broadcast
END = as_long(span_hashes(np.frombuffer(b"\n", np.uint8), np.array([0]), np.array([1])))[0]


def held_out(key: str) -> Column:
    """crc32 of the key as text, modulo 5, is 1."""
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    return F.crc32(k.cast("binary")) % 5 == 1


def _tokens(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces (first row, word hashes with an end token after every row, row offsets)."""
    for lo, h, rows in hashed_words(column):
        n = len(rows) - 1
        out = np.full(len(h) + n, END, dtype=np.int64)
        at = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(rows))
        out[at] = as_long(h)
        yield lo, out, rows + np.arange(n + 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of about 8 million tokens at a time with their counts."""
    held, size = [], 0

    def out():
        w = np.concatenate(held)
        w, c = np.unique(w, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(c.astype(np.int64))], names=["w", "c"])
    for b in batches:
        for _, t, _ in _tokens(b.column(0)):
            held.append(t)
            size += len(t)
            if size >= 4_000_000:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _lookup(table: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``words`` in the sorted ``table``, and whether they are there."""
    if not len(table):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return at, table[at] == words


def _bigram_counter(shared):
    """Bigram counts of vocabulary places, summed over the task, as sparse blocks of rows.

    Places: the clustered words in hash order, the end token, all other words.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        size = m.places
        total = np.zeros(size * size, dtype=np.int32)
        for b in batches:
            for _, t, rows in _tokens(b.column(0)):
                now = m.place(t)
                before = np.empty_like(now)
                before[1:] = now[:-1]
                before[rows[:-1]] = size - 2
                cell, c = np.unique(before * size + now, return_counts=True)
                total[cell] += c.astype(np.int32)
        for lo in range(0, size, ROW_BLOCK):
            part = total[lo * size:(lo + ROW_BLOCK) * size]
            cell = np.flatnonzero(part)
            if len(cell):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lo // ROW_BLOCK], pa.int32()), pa.array([cell.astype(np.int32).tobytes()], pa.binary()),
                     pa.array([part[cell].tobytes()], pa.binary())], names=["block", "cells", "counts"])
    return count


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the messages of each block that this task has; a block is a fixed number of cells."""
    sums: dict[int, tuple] = {}
    for b in batches:
        for block, cells, counts in zip(*(b.column(c).to_pylist() for c in ("block", "cells", "counts"))):
            cells, counts = np.frombuffer(cells, np.int32), np.frombuffer(counts, np.int32).astype(np.int64)
            if block in sums:
                cells = np.concatenate([sums[block][0], cells])
                counts = np.concatenate([sums[block][1], counts])
                cells, inverse = np.unique(cells, return_inverse=True)
                counts = np.bincount(inverse, weights=counts).astype(np.int64)
            sums[block] = (cells, counts)
    for block, (cells, counts) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cells.tobytes()], pa.binary()),
                                          pa.array([counts.tobytes()], pa.binary())],
                                         names=["block", "cells", "counts"])


def exchange(rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, size: int, order: np.ndarray,
             start: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """Exchange clustering: classes of ``size`` places from sparse bigram counts.

    ``order`` lists the places that may move, most frequent first; the others
    keep the class of ``start``.  The likelihood's part that classes change is
    sum f(N(c, d)) - sum f(N(c, .)) - sum f(N(., c)) with f(x) = x log x.
    """
    cls = start.copy()
    k = int(cls.max()) + 1 if len(cls) else classes
    both = np.zeros((k, k))
    np.add.at(both, (cls[rows], cls[cols]), counts)
    by_row, by_col = np.argsort(rows, kind="stable"), np.argsort(cols, kind="stable")
    row_at, col_at = np.searchsorted(rows[by_row], np.arange(size + 1)), np.searchsorted(cols[by_col], np.arange(size + 1))

    def f(x):
        return x * np.log(np.maximum(x, 1e-300))
    for _ in range(passes):
        moved = 0
        for w in order:
            r, c = by_row[row_at[w]:row_at[w + 1]], by_col[col_at[w]:col_at[w + 1]]
            own = counts[r][cols[r] == w].sum()
            nxt = np.bincount(cls[cols[r]], weights=counts[r], minlength=k)
            prv = np.bincount(cls[rows[c]], weights=counts[c], minlength=k)
            a = cls[w]
            nxt[a] -= own
            prv[a] -= own
            both[a, :] -= nxt                         # take the word out of its class
            both[:, a] -= prv
            both[a, a] -= own
            # gain of putting it into each class c: changes of row c, column c and the cell (c, c)
            row = f(both + nxt) - f(both)
            col = f(both + prv[:, None]) - f(both)
            diag = np.diag(both)
            gain = row.sum(axis=1) - np.diag(row) + col.sum(axis=0) - np.diag(col)
            gain += f(diag + nxt + prv + own) - f(diag)
            out, into = both.sum(axis=1), both.sum(axis=0)
            gain -= f(out + nxt.sum() + prv + own) - f(out)      # class c's row also gets the words before w in c
            gain -= f(into + prv.sum() + nxt + own) - f(into)
            b = int(np.argmax(gain[:classes] + 1e-9 * (np.arange(classes) == a)))
            both[b, :] += nxt
            both[:, b] += prv
            both[b, b] += own
            if b != a:
                cls[w] = b
                moved += 1
        if moved <= len(order) // 200:
            break
    return cls


def _smoothed(trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(class | class before) of class counts, and each class's share."""
    into = trans.sum(axis=0) + ALPHA
    share = into / into.sum()
    return (trans + PRIOR * K * share) / (trans.sum(axis=1, keepdims=True) + PRIOR * K), share


class Model:
    """The broadcast words with counts and classes, and the smoothed logarithms; of a fixed size whatever the corpus."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, ends: int, total: int, distinct: int):
        if END not in known:                              # the end token is always among them
            known, counts = np.append(known, END), np.append(counts, ends)
        order = np.lexsort((known, -counts))
        first = order[(known[order] != END) & (counts[order] >= MIN_COUNT)][:CLUSTERED]
        by_hash = np.argsort(known)
        self.words, self.counts = known[by_hash], counts[by_hash]
        self.cls = np.full(len(known), RARE, np.uint8)
        self.cls[self.words == END] = END_CLASS
        self.log_base = math.log10(total + ALPHA * (distinct + 1))
        self.total = total
        self.first_words = np.sort(known[first])
        self.first_counts = self.counts[np.searchsorted(self.words, self.first_words)]
        self.places = len(self.first_words) + 2

    def place(self, tokens: np.ndarray) -> np.ndarray:
        """Places of the bigram matrix that the start is made from."""
        at, found = _lookup(self.first_words, tokens)
        n = len(self.first_words)
        return np.where(found, at, np.where(tokens == END, n, n + 1))

    def start(self, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Class the most frequent words by exchange; returns the class counts."""
        n = len(self.first_words)
        order = np.lexsort((self.first_words, -self.first_counts))
        begin = np.concatenate([np.zeros(n, np.int64), [END_CLASS, RARE]])
        begin[order] = np.arange(n) % END_CLASS
        cls = exchange(rows, cols, counts, self.places, order, begin, END_CLASS)
        self.cls[np.searchsorted(self.words, self.first_words)] = cls[:n]
        trans = np.zeros((K, K))
        np.add.at(trans, (cls[rows], cls[cols]), counts)
        return trans

    def learn(self, words: np.ndarray, classes: np.ndarray) -> None:
        """Take over the classes of a round."""
        at, found = _lookup(self.words, words)
        self.cls[at[found]] = classes[found]              # words without one keep RARE

    def known(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and classes of tokens, 0 and TAIL where the word is not broadcast."""
        at, found = _lookup(self.words, tokens)
        return np.where(found, self.counts[at], 0), np.where(found, self.cls[at], TAIL).astype(np.uint8)


def _neighbours(shared, open_tail: bool):
    """For every word but the end token, the classes beside it: (w, cells, counts), cell = class, + K if before it.

    Neighbours that are not broadcast are rare ones or, with ``open_tail``, come
    one by one as nb with the cell of class 0.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = ["w", "cells", "counts", "nb"]
        held, size = [], 0

        def out():
            w, key = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            w, at = np.unique(w, return_inverse=True)
            key, n = np.unique(at * (2 * K) + key, return_counts=True)
            start = np.searchsorted(key, np.arange(len(w) + 1) * (2 * K))
            for lo in range(0, len(w), 20_000):
                hi = min(lo + 20_000, len(w))
                part = slice(start[lo], start[hi])
                off = pa.array((start[lo:hi + 1] - start[lo]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[lo:hi]), pa.ListArray.from_arrays(off, pa.array((key[part] % (2 * K)).astype(np.int32))),
                     pa.ListArray.from_arrays(off, pa.array(n[part].astype(np.int64))), pa.nulls(hi - lo, pa.int64())],
                    names=names)
        for b in batches:
            for _, t, rows in _tokens(b.column(0)):
                c = m.known(t)[1]
                if not open_tail:
                    c = np.where(c == TAIL, RARE, c).astype(np.uint8)
                at = np.flatnonzero(t != END)                      # an end token follows, as it ends every row
                before, prev = np.empty_like(c), np.empty_like(t)
                before[1:], prev[1:] = c[:-1], t[:-1]
                before[rows[:-1]], prev[rows[:-1]] = END_CLASS, END
                w = np.concatenate([t[at], t[at]])
                beside = np.concatenate([c[at + 1], before[at]])
                base = np.repeat(np.array([0, K]), len(at))
                far = beside == TAIL
                held.append((w[~far], base[~far] + beside[~far]))
                size += len(w)
                if far.any():
                    nb, k = np.concatenate([t[at + 1], prev[at]])[far], int(far.sum())
                    off = pa.array(np.arange(k + 1, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w[far]), pa.ListArray.from_arrays(off, pa.array(base[far].astype(np.int32))),
                         pa.ListArray.from_arrays(off, pa.array(np.ones(k, np.int64))), pa.array(nb)], names=names)
                if size >= 4_000_000:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()
    return count


def _assign(shared):
    """The class of every word of MIN_COUNT or more, from its neighbours' classes (rows sorted by word).

    Besides, one row per task with the class counts that follow.
    """
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prob, share = _smoothed(shared.value)
        pull = np.log(prob) - np.log(share)
        trans = np.zeros((K, K))
        word, sums = np.zeros(0, np.int64), np.zeros((0, 2 * K))

        def out(w, x):
            c = x[:, K:].sum(axis=1).astype(np.int64)
            gain = np.round(x[:, :K] @ pull.T + x[:, K:] @ pull, 6)[:, :END_CLASS]
            cls = np.where(c >= MIN_COUNT, np.argmax(gain, axis=1), RARE)
            np.add.at(trans, cls, x[:, :K])
            np.add.at(trans[END_CLASS], cls, x[:, K + END_CLASS])
            keep = c >= MIN_COUNT
            return pa.RecordBatch.from_arrays(
                [pa.array(w[keep]), pa.array(c[keep]), pa.array(cls[keep].astype(np.int32)),
                 pa.nulls(int(keep.sum()), pa.binary())], names=["w", "c", "cls", "trans"])
        for b in batches:
            if not b.num_rows:
                continue
            w, sizes = b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy())
            new = np.concatenate([[True], w[1:] != w[:-1]])
            at, w = np.repeat(np.cumsum(new) - 1, sizes), w[new]
            x = np.bincount(at * (2 * K) + b.column(1).flatten().to_numpy(), weights=b.column(2).flatten().to_numpy(),
                            minlength=len(w) * 2 * K).reshape(len(w), 2 * K)
            if len(word) and word[0] == w[0]:                     # the word that the batch before ended with
                x[0] += sums[0]
            elif len(word):
                w, x = np.concatenate([word, w]), np.concatenate([sums, x])
            word, sums = w[-1:], x[-1:]
            yield out(w[:-1], x[:-1])
        yield out(word, sums)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                                          pa.array([trans.tobytes()], pa.binary())], names=["w", "c", "cls", "trans"])
    return assign


def _round(texts: DataFrame, model: Model, trans: np.ndarray, before: DataFrame | None, folder: str,
           name: str) -> tuple[DataFrame, np.ndarray]:
    """One round: the classes (w, c, cls) of all words of MIN_COUNT or more, and the class counts that follow."""
    spark = texts.sparkSession
    cells = texts.mapInArrow(_neighbours(spark.sparkContext.broadcast(model), before is not None),
                             "w bigint, cells array<int>, counts array<bigint>, nb bigint")
    cells = write_table(cells, folder, f"{name}-cells")
    beside = cells.where("nb is null").select("w", "cells", "counts")
    if before is not None:
        far = cells.where("nb is not null").select("w", "nb", F.col("cells")[0].alias("cell"))
        far = far.join(before.select(F.col("w").alias("v"), "cls"), F.col("nb") == F.col("v"), "left")
        far = far.groupBy("w", (F.col("cell") + F.coalesce("cls", F.lit(RARE))).alias("cell")).agg(F.count("*").alias("n"))
        far = far.groupBy("w").agg(F.collect_list(F.struct("cell", "n")).alias("x"))
        far = far.select("w", F.col("x.cell").alias("cells"), F.col("x.n").alias("counts"))
        far = write_table(far, folder, f"{name}-far")
        release(spark)
        beside = beside.unionByName(far)
    found = beside.repartition("w").sortWithinPartitions("w").mapInArrow(
        _assign(spark.sparkContext.broadcast(trans)), "w bigint, c bigint, cls int, trans binary")
    found = write_table(found, folder, name)
    drop_table(spark, folder, f"{name}-cells")
    drop_table(spark, folder, f"{name}-far")
    release(spark)
    after = np.zeros(K * K)
    for r in found.where("trans is not null").select("trans").toLocalIterator():       # K ** 2 counts each
        after += np.frombuffer(r["trans"])
    classes = found.where("w is not null").select("w", "c", "cls")
    top = classes.orderBy(F.desc("c"), "w").limit(KNOWN).toArrow()
    model.learn(top["w"].to_numpy(), top["cls"].to_numpy())
    return classes, after.reshape(K, K)


def _coder(shared):
    """Every text's tokens as classes (TAIL: not broadcast), its sums over the broadcast words, and the other words.

    These come in text order with the classes before and after (TAIL: again such a word).
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, t, rows in _tokens(b.column("text")):
                count, c = m.known(t)
                found = c != TAIL
                own = np.where(found, np.log10(count + ALPHA), 0.0)
                in_class = np.where(found, m.log_class[np.minimum(c, RARE)], 0.0)
                cum = lambda x: np.concatenate([[0], np.cumsum(x)])[rows]
                n, miss = np.diff(rows), np.flatnonzero(~found)
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[rows[:-1]] = END_CLASS
                row_of = np.searchsorted(rows, miss, side="right") - 1
                rare = pa.StructArray.from_arrays([pa.array(t[miss]), pa.array(before[miss].astype(np.int32)),
                                                   pa.array(c[miss + 1].astype(np.int32))], names=["w", "before", "after"])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row_of, np.arange(len(rows))).astype(np.int32)), rare)
                raw, k = c.tobytes(), len(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").slice(lo, k), b.column("held_out").slice(lo, k), pa.array(n.astype(np.int64)),
                     pa.array(np.diff(cum(count > 0)).astype(np.int64)), pa.array(np.diff(cum(own)) - n * m.log_base),
                     pa.array(np.diff(cum(own - in_class))),
                     pa.array([raw[x:y] for x, y in zip(rows[:-1], rows[1:])], pa.binary()), lists],
                    names=["key", "held_out", "n_tokens", "n_known", "base", "own", "codes", "rare"])
    return code


def _steps(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of coded texts: row offsets, class before and class of every token, and whether both are broadcast words'."""
    rows = np.concatenate([[0], np.cumsum(b.column("n_tokens").to_numpy())])
    c = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8)
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[rows[:-1]] = END_CLASS
    return rows, before, c, (before != TAIL) & (c != TAIL)


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the steps between broadcast words, cell = class before * K + class."""
    total = np.zeros(K * K, np.int64)
    for b in batches:
        if b.num_rows:
            _, before, c, both = _steps(b)
            total += np.bincount(before[both].astype(np.int64) * K + c[both], minlength=K * K)
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])


def _scorer(shared):
    """The sum of the steps between broadcast words, for every coded text."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_trans = np.append(shared.value[0].ravel(), 0.0)
        for b in batches:
            if not b.num_rows:
                continue
            rows, before, c, both = _steps(b)
            step = log_trans[np.where(both, before.astype(np.int64) * K + c, K * K)]
            steps = np.diff(np.concatenate([[0], np.cumsum(step)])[rows])
            yield pa.RecordBatch.from_arrays([b.column(x) for x in ("row", "key", "held_out", "n_tokens", "n_known", "base")]
                                             + [pa.array(b.column("own").to_numpy() + steps)],
                                             names=["row", "key", "held_out", "n_tokens", "n_known", "base", "model"])
    return score


def _rare_scorer(shared):
    """Whether a word that is not broadcast is known, and its sums with the steps to and from it."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_trans, log_class = shared.value
        log_trans = np.vstack([log_trans.T, np.zeros(K)]).T        # no step from here where the next word has it
        for b in batches:
            c, cls, before, after = (b.column(x).to_numpy() for x in ("c", "cls", "before", "after"))
            own = np.log10(c + ALPHA)
            model = own - log_class[cls] + log_trans[before, cls] + log_trans[cls, np.minimum(after, K)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array((c > 0).astype(np.int64)), pa.array(own),
                                              pa.array(model)], names=["row", "seen", "own", "model"])
    return score


def train(docs: DataFrame, folder: str, text: str = "text") -> tuple[Model, DataFrame]:
    """The broadcast words and classes of all rows of ``docs``, and the table of all words (w, c, cls)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    words = texts.mapInArrow(_count_words, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))
    words = write_table(words, folder, "words")
    total, distinct = words.agg(F.sum("c"), F.count("*")).first()
    top = words.orderBy(F.desc("c"), "w").limit(KNOWN).toArrow()          # KNOWN rows: the broadcast's size
    ends = words.where(F.col("w") == int(END)).agg(F.sum("c")).first()[0] or 0
    model = Model(top["w"].to_numpy(), top["c"].to_numpy(), ends, total or 0, distinct)
    blocks = texts.mapInArrow(_bigram_counter(spark.sparkContext.broadcast(model)),
                              "block int, cells binary, counts binary")
    blocks = blocks.repartition(-(-model.places // ROW_BLOCK), "block") \
        .mapInArrow(_sum_blocks, "block int, cells binary, counts binary")
    got = [(r["block"], np.frombuffer(r["cells"], np.int32), np.frombuffer(r["counts"], np.int64))
           for r in write_table(blocks, folder, "bigrams").toLocalIterator()]     # at most places ** 2 cells
    release(spark)
    cells = np.concatenate([c.astype(np.int64) + b * ROW_BLOCK * model.places for b, c, _ in got] or [np.zeros(0, np.int64)])
    counts = np.concatenate([n for _, _, n in got] or [np.zeros(0, np.int64)]).astype(np.float64)
    trans, classes = model.start(cells // model.places, cells % model.places, counts), None
    for i in range(ROUNDS):
        classes, trans = _round(texts, model, trans, classes, folder, f"round{i}")
    cls = F.when(F.col("w") == int(END), END_CLASS).otherwise(F.coalesce("cls", F.lit(RARE))).alias("cls")
    found = words.join(classes.select(F.col("w").alias("v"), "cls"), F.col("w") == F.col("v"), "left")
    lexicon = write_table(found.select("w", "c", cls), folder, "lexicon")
    in_class, kinds = np.zeros(K), np.zeros(K)
    for r in lexicon.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():        # K rows
        in_class[r["cls"]], kinds[r["cls"]] = r["c"], r["n"]
    kinds[RARE] += 1                                                      # and one for all unseen words
    model.log_class = np.log10(in_class + ALPHA * np.maximum(kinds, 1))
    return model, lexicon


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", training: Column | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Training rows are those not held out, or those where ``training`` holds.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "lm")
    out = held_out(key) if training is None else ~training
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), out.alias("held_out"))
    model, lexicon = train(d.where(~F.col("held_out")), folder)
    kind = dict(d.dtypes)["key"]
    part = d.mapInArrow(_coder(spark.sparkContext.broadcast(model)),
                        f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, own double, "
                        "codes binary, rare array<struct<w:bigint,before:int,after:int>>")
    part = write_table(part.withColumn("row", F.monotonically_increasing_id()), folder, "coded")
    # the words that are not broadcast get count and class by a join; the one before such a word may be another
    rare = part.select("row", "held_out", F.posexplode("rare").alias("i", "x")).select("row", "held_out", "i", "x.*")
    rare = rare.join(lexicon.withColumnRenamed("w", "v"), F.col("w") == F.col("v"), "left").select(
        "row", "held_out", "i", "before", "after", F.coalesce("c", F.lit(0)).alias("c"),
        F.coalesce("cls", F.lit(RARE)).alias("cls"))
    lag = F.lag("cls").over(Window.partitionBy("row").orderBy("i"))
    rare = rare.withColumn("before", F.when(F.col("before") == TAIL, lag).otherwise(F.col("before")))
    rare = write_table(rare, folder, "rare")
    release(spark)
    into, onward = F.col("before") * K + F.col("cls"), F.when(F.col("after") < K, F.col("cls") * K + F.col("after"))
    steps = part.where(~F.col("held_out")).select("n_tokens", "codes").mapInArrow(_transitions, "cell int, n bigint")
    for cell in (into, onward):
        steps = steps.union(rare.where(~F.col("held_out") & cell.isNotNull()).groupBy(cell.alias("cell")).agg(
            F.count("*").alias("n")))
    trans = np.zeros(K * K)
    for r in steps.groupBy("cell").agg(F.sum("n").alias("n")).collect():                  # at most K ** 2 rows
        trans[r["cell"]] = r["n"]
    log_trans = np.log10(_smoothed(trans.reshape(K, K))[0])
    shared = spark.sparkContext.broadcast((log_trans, model.log_class))
    tail = rare.select("row", "c", "cls", "before", "after").mapInArrow(
        _rare_scorer(shared), "row bigint, seen bigint, own double, model double").groupBy("row").agg(
        F.sum("seen").alias("seen"), F.sum("own").alias("rare_own"), F.sum("model").alias("rare_model"))
    part = part.drop("rare").mapInArrow(
        _scorer(shared), f"row bigint, key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, "
        "model double")
    x = part.join(tail.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    zero = F.lit(0.0)
    return x.select("key", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
                    F.lit(model.total).cast("bigint").alias("train_tokens"),
                    (F.col("base") + F.coalesce("rare_own", zero)).alias("base_score"),
                    (F.col("model") + F.coalesce("rare_model", zero)).alias("score"))
