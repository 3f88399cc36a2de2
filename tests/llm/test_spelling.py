"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from souq.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    counts = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 5}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        i = 0
        while i < len(a) and a[i] == b[i]:
            i += 1
        return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]

    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    form, n_near = {}, {}
    for w, n in words.items():
        o = [x for k in (-1, 0, 1) for x in by_size.get(len(w) + k, ()) if near(w, x)]
        n_near[w] = len(o)
        best = min(o, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], words[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, rows, schema="doc_id bigint, text string"):
    got = spelling.variants(spark.createDataFrame(rows, schema)).collect()
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got)


def test_random_words(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abéÿ") for _ in range(rng.randrange(5, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocab).title() if rng.random() < .2 else rng.choice(vocab)
                         for _ in range(rng.randrange(0, 120))) + ",1Éa×÷b") for i in range(300)]
    want = brute(rows)
    assert len(want) > 100 and any(r[1] for r in want)
    assert run(spark, rows) == want


def test_chains_of_forms(spark):
    rows = [(1, "strands " * 5), (2, "strand " * 25), (3, "strand's brand " * 130), (4, "strond " * 5 + "strang " * 5),
            (5, "stand " * 700), (None, "stands " * 140), (7, "aaaaaaa " * 5 + "aaaaaa " * 6 + "aabaaaa " * 5),
            (8, "aaaabbb " * 5 + "aaaabbc " * 30 + "aaaabcc " * 200 + "baaabcc " * 1000)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[0]: r[2] for r in got}["aaaabbb"] == "baaabcc"


def test_edges(spark):
    assert run(spark, [(1, None), (2, ""), (3, "1234 中文 Ābcdefg"), (None, "abc def")]) == []
    assert run(spark, []) == []
    rows = [("x", "Äpfel ÄPFELN " * 9), ("x", "Äpfel ÄPFELN " * 9), (None, "äpfeln " * 9)]
    assert run(spark, rows, "doc_id string, text string") == brute(rows)


def test_very_long_words_and_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcd") for _ in range(30_000))
    rows = [(i, f"{long} {long[:-1]}") for i in range(8)] + [(99, "wonder " * 400_000 + "wonders " * 9)]
    assert run(spark, rows) == brute(rows)


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "wonder " * 9, 5, "a", "b")], "doc_id bigint, text string, n int, word string, w string")
    assert [r.word for r in spelling.variants(df).collect()] == ["wonder"]


def test_sf001_documents(spark):
    from souq.llm.queries import op12_spelling_variants

    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op12_spelling_variants(spark, path).select(
        "word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute(rows) and any(r[1] for r in got)
