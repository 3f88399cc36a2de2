"""The pipeline against direct Python statements of its stages, each applied to what the one before it kept."""

import math
import os
import re
import sys
from collections import Counter

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from souq.llm import queries  # noqa: E402
from souq.llm.common import work_folder, write_table  # noqa: E402
from souq.llm.decontamination import question_answer, words_of  # noqa: E402
from souq.llm.oracles import MIXING  # noqa: E402
from test_brute_force import brute_line_runs  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PHRASES = re.compile(r"javascript|cookies? policy|use of cookies|accept (?:all )?cookies|all rights reserved|privacy policy"
                     r"|terms (?:of|and) (?:use|service|conditions)|lorem ipsum|sign in|log ?in|subscribe (?:now|to)"
                     r"|newsletter|click here|read more|share (?:this|on)|back to top|powered by|skip to (?:main )?content"
                     r"|\bcopyright\b|©", re.I | re.A)


def bad_line(x):
    w = WORD.findall(x)
    ends = re.search(r"[.!?…。！？][\"')\]»”’]*(?:[\x20\x09-\x0D]|\Z)", x)
    shouts = sum(bool(re.search(r"[!?]{2,}\Z", v)) for v in w)
    marks = sum(bool(re.fullmatch(r"[|>»•·›/]+", v)) for v in w)
    symbols = sum(c in "#*$%&|<>" for c in x)
    return (not ends or 2 * shouts > len(w) or 4 * marks >= len(w) or 10 * symbols > len(x)
            or len(w) <= 20 and bool(PHRASES.search(x)))


def quality(texts):
    out = {}
    for k, t in texts.items():
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        repeated = {i + j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(8)}
        if len(w) < 20 or 100 * len(repeated) > 30 * len(w):
            continue
        lines = t.split("\n")
        full = [x for x in lines if WORD.search(x)]
        good = [x for x in lines if not WORD.search(x) or not bad_line(x)]
        left = sum(len(x) for x in good if WORD.search(x))
        if not full or 1 - left / sum(map(len, full)) <= 0.5:
            out[k] = "\n".join(good)
    return out


def one_of_near_copies(texts):
    sets = {}
    for k, t in texts.items():
        w = t.encode().lower().split()
        sets[k] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sets[a] and label[a] != label[b] and \
                    100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    return {k: t for k, t in texts.items() if label[k] == k}


def without_items(texts, items):
    """BM25 of every window of two segments with every item, by its formula."""
    words = {i: words_of(t) for i, t in items.items() if words_of(t)}
    longest, n = max(map(len, words.values())), len(words)
    mean = sum(map(len, words.values())) / n
    df = Counter(x for w in words.values() for x in set(w))
    impact = {}
    for i, w in words.items():
        tf = Counter(w)
        v = {x: math.log(1 + (n - df[x] + .5) / (df[x] + .5)) * c * 2.2 / (c + 1.2 * (1 - .75 + .75 * len(w) / mean))
             for x, c in tf.items()}
        impact[i] = {x: y / sum(v.values()) for x, y in v.items()}
    grams = lambda w, size: {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
    out = {}
    for k, t in texts.items():
        w, hit = words_of(t), False
        for begin in range(0, len(w), longest):
            window = w[begin:begin + 2 * longest]
            have = set(window)
            for i, v in impact.items():
                if sum(y for x, y in v.items() if x in have) < 0.7 - 1e-9:
                    continue
                shares = []
                for part in map(words_of, question_answer(items[i])):
                    size = min(3, len(part)) or 1
                    want = grams(part, size)
                    shares.append(len(want & grams(window, size)) / len(want) if want else 1)
                hit = hit or min(shares) >= 0.8
        if not hit:
            out[k] = t
    return out


@pytest.fixture(scope="module")
def expected(spark):
    docs = {r.doc_id: r for r in queries.table(spark, SF, "documents").collect()}
    items = {r.item_id: r.text for r in queries.table(spark, SF, "benchmark").collect()}
    steps = [quality({k: r.text for k, r in docs.items()})]
    steps.append(brute_line_runs(steps[-1]))
    steps.append(one_of_near_copies(steps[-1]))
    steps.append(without_items(steps[-1], items))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(k, t, docs[k].source) for k, t in steps[-1].items()],
                                           columns=["doc_id", "text", "source"]))
    taken = {r[0]: (r[1], r[4]) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({MIXING})").fetchall()}
    return steps, taken


def test_every_stage(spark, expected):
    steps, taken = expected
    folder = work_folder(spark, "stages")
    d = queries.table(spark, SF, "documents")
    sizes = [d.count()]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], steps):
        d = write_table(stage(spark, d, SF), folder, name)
        got = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
        assert got == want, name
        sizes.append(len(got))
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[4] < sizes[2]


def test_the_whole_pipeline(spark, expected):
    steps, taken = expected
    got = {r.doc_id: (r.text, r.copies) for r in corpus_pipeline.run(spark, SF).collect()}
    assert {k: v for k, v in got.items() if taken[k][0]} == {
        k: (steps[-1][k], t // size) for k, (size, t) in taken.items() if size and t}
