"""Repeated windows against brute force, and the automaton by itself."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from souq.llm import automaton_dedup as ad

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=13):
    """{(key, text): (n_words, n_removed, kept)}; null keys are the largest."""
    low = {}
    words = [(k, t, WORD.findall(t or "")) for k, t in rows]
    rank = lambda k: (k is None, k if k is not None else 0)
    for k, _, w in words:
        for i in range(len(w) - length + 1):
            g = tuple(w[i:i + length])
            low[g] = min(low.get(g, rank(k)), rank(k))
    out = {}
    for k, t, w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if low[tuple(w[i:i + length])] < rank(k):
                gone.update(range(i, i + length))
        out[k, t] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def run(spark, rows, **params):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ad.dedup(df, **params).collect()
    assert len(got) == len(rows)
    return sorted(((r.key, r.n_words, r.n_removed, r.kept) for r in got), key=str)


def expected(rows):
    b = brute(rows)
    return sorted(((k, *b[k, t]) for k, t in rows), key=str)


def test_random_texts_with_copied_passages(spark):
    rng = random.Random(5)
    vocab = [f"w{i}é" for i in range(60)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([12, 13, 14, 20, 45]))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += rng.choice(passages)[rng.randrange(0, 3):] if rng.random() < .5 else [rng.choice(vocab) for _ in range(rng.randrange(1, 30))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    assert run(spark, rows) == expected(rows)


def test_edges(spark):
    line = " ".join(f"t{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, line), (5, line), (5, "x " + line), (None, line + " z"),
            (None, line + " q"), (9, " ".join(["same"] * 3000)), (10, " ".join(["same"] * 50)),
            (11, "\x01 " + line[:60]), (12, "y " * 13), (12, "y " * 14)]
    assert run(spark, rows) == expected(rows)


def test_text_keys_and_extra_columns(spark):
    line = " ".join(f"t{i}" for i in range(20))
    df = spark.createDataFrame([("b", line, 1, "x"), ("a", line, 2, "y"), (None, line, 3, None)],
                               "doc_id string, text string, fp int, id string")
    got = {r.key: r.n_removed for r in ad.dedup(df).collect()}
    assert got == {"a": 0, "b": 20, None: 20}


def test_empty_table(spark):
    assert ad.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_split_to_windows(spark, hot):
    rng = random.Random(2)
    core = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join([f"u{rng.randrange(4)}" for _ in range(9)] + core + [f"v{rng.randrange(4)}" for _ in range(9)]))
            for i in range(60)]
    assert run(spark, rows, hot=hot) == expected(rows)


def test_small_shards_agree(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 80)))) for i in range(60)]
    assert run(spark, rows, shard=20) == expected(rows)


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(200):
        texts = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        a = ad.SuffixAutomaton()
        for t in texts[:-1]:
            a.add(t)
        q = texts[-1]
        subs = {tuple(t[i:j]) for t in texts[:-1] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max((n for n in range(1, i + 2) if tuple(q[i + 1 - n:i + 1]) in subs), default=0) for i in range(len(q))]
        assert a.statistics(q) == want
        assert len(a.next) <= 2 * sum(map(len, texts)) + 1


def test_sf001_documents(spark):
    """All documents of the smallest table, with the digest of the query."""
    from souq.llm.queries import op11_automaton_dedup

    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((k, n, r, hashlib.sha256(t.encode()).hexdigest()) for (k, _), (n, r, t) in brute(rows).items())
    got = sorted(tuple(r) for r in op11_automaton_dedup(spark, path).select(
        "doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want and sum(r[2] for r in got)
