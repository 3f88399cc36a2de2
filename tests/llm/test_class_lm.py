"""The class model: no word's class or score depends on its rank, and scores add up by brute force."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from souq.llm import class_lm as lm
from souq.llm.common import work_folder


def texts(n=120, seed=5):
    """Two kinds of sentences over a few common and many less common words, and words seen once."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = []
        for _ in range(r.randint(0, 12)):
            t += [r.choice(["The", "a"]), f"noun{min(int(r.expovariate(0.05)), 90)}", r.choice(["sees", "likes"]),
                  f"thing{min(int(r.expovariate(0.08)), 60)}"]
            if r.random() < 0.1:
                t.append(f"once{i}x{len(t)}")
        out.append((i, " ".join(t) if t or i % 2 else None))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id bigint, text string").repartition(3)


def results(docs):
    return {r["key"]: (r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6))
            for r in lm.score(docs).collect()}


@pytest.mark.parametrize("known", [9, 40])
def test_rank_changes_nothing(docs, monkeypatch, known):
    monkeypatch.setattr(lm, "CLUSTERED", 6)
    whole = results(docs)
    monkeypatch.setattr(lm, "KNOWN", known)              # the others get counts and classes by joins
    assert results(docs) == whole


def lexicon(spark, docs):
    model, table = lm.train(docs.where(~lm.held_out("doc_id")), work_folder(spark, "lm"))
    return model, {r["w"]: (r["c"], r["cls"]) for r in table.collect()}


def test_every_repeated_word_is_clustered(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "CLUSTERED", 6)
    monkeypatch.setattr(lm, "KNOWN", 20)
    _, words = lexicon(spark, docs)
    assert len(words) > 100
    for w, (c, cls) in words.items():
        assert cls == lm.END_CLASS if w == lm.END else (cls < lm.END_CLASS) == (c >= lm.MIN_COUNT), (w, c, cls)


def test_scores_add_up(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 20)
    _, words = lexicon(spark, docs)
    tokens = {}
    for d, t in texts():
        (_, h, _), = lm._tokens(pa.array([t], pa.string()))
        tokens[d] = [int(x) for x in h]
    trans, size, kinds = np.zeros((lm.K, lm.K)), collections.Counter(), collections.Counter({lm.RARE: 1})
    for c, cls in words.values():
        size[cls] += c
        kinds[cls] += 1
    cls_of = lambda w: words.get(w, (0, lm.RARE))[1]
    for d, t in tokens.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            for a, b in zip([int(lm.END), *t], t):
                trans[cls_of(a), cls_of(b)] += 1
    into = trans.sum(axis=0) + lm.ALPHA
    prob = (trans + lm.PRIOR * lm.K * into / into.sum()) / (trans.sum(axis=1, keepdims=True) + lm.PRIOR * lm.K)
    assert prob.sum(axis=1) == pytest.approx(np.ones(lm.K))
    got = {r["key"]: r["score"] for r in lm.score(docs).collect()}
    for d, t in tokens.items():
        want = sum(math.log10(prob[cls_of(a), cls_of(b)]) + math.log10(
            (words.get(b, (0, 0))[0] + lm.ALPHA) / (size[cls_of(b)] + lm.ALPHA * kinds[cls_of(b)]))
            for a, b in zip([int(lm.END), *t], t))
        assert got[d] == pytest.approx(want), d
