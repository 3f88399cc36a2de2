"""Parities refuse candidate pairs before whole sets are fetched, and never one that links."""

import random

import numpy as np
import pytest

from souq.llm import jaccard_join as jj


def differ(a, b):
    return int(np.bitwise_count(jj.parities(a) ^ jj.parities(b)).sum())


def linked(a, b):
    both = len(np.intersect1d(a, b))
    return 100 * both >= jj.PERCENT * (len(a) + len(b) - both)


@pytest.mark.parametrize("size", [1, 5, 40, 300, 3000])
def test_no_linked_pair_is_refused(size):
    r = np.random.default_rng(size)
    n_linked = 0
    for i in range(200):
        a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        own = r.integers(0, 1 << 63, int(r.integers(0, size // 4 + 2)), dtype=np.uint64)
        b = np.unique(np.concatenate([a[int(r.integers(0, size // 4 + 1)):], own]))
        assert differ(a, b) <= len(np.setxor1d(a, b))
        if len(b) and linked(a, b):
            n_linked += 1
            assert (100 + jj.PERCENT) * differ(a, b) <= (100 - jj.PERCENT) * (len(a) + len(b))
    assert n_linked


def test_unlike_pairs_are_refused(spark):
    r = random.Random(3)
    base = [f"w{r.randint(0, 10 ** 9)}" for _ in range(300)]
    texts = [base, base[:296] + ["x"] * 4, base[:150] + [f"v{i}" for i in range(150)], [f"u{i}" for i in range(300)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    j = jj._Join(docs, "doc_id", "text")
    node = {x["label"]: x["node"] for x in j.nodes.collect()}
    pairs = spark.createDataFrame([(node[a], node[b]) for a in range(4) for b in range(a)], "a bigint, b bigint")
    assert [{x["a"], x["b"]} for x in j.likely(pairs).collect()] == [{node[0], node[1]}]
