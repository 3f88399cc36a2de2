"""Alignment of two tokenizers against a direct computation on byte offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from souq.llm import alignment
from souq.llm.queries import TOKENIZERS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def letters():
    """The byte of every letter of a byte-level vocabulary, counted up anew."""
    out, extra = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[chr(b)] = b
        else:
            out[chr(extra)] = b
            extra += 1
    return out


def tokens(encoders, text):
    t, sp = encoders
    table = letters()
    a = [(i, bytes(table[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode())
         for i, p in ((i, sp.id_to_piece(i)) for i in sp.encode(text))]
    raw = b" " + text.encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def brute(encoders, rows):
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of every row."""
    found, count = [], Counter()
    for key, text in rows:
        a, b = tokens(encoders, text) if text else ([], [])
        ends = []
        for side in (a, b):
            at, e = 0, []
            for _, x in side:
                at += len(x)
                e.append(at)
            ends.append(e)
        links = [(a[i][0], b[ends[1].index(e)][0]) for i, e in enumerate(ends[0]) if e in set(ends[1])]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, before = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(side[i][0]) for i, x in enumerate(es) if before < x <= e)
                                   for side, es in ((a, ends[0]), (b, ends[1]))))
            before = e
        count.update(links)
        found.append((key, len(a), len(b), len(groups), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(((key, na, nb, ng, len(links), sum(count[x] == most[x[1]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if na else "")
                   for key, na, nb, ng, links, g in found), key=str)


def run(spark, rows, schema="doc_id bigint, text string", **params):
    got = alignment.align(spark.createDataFrame(rows, schema), A, B, **params).collect()
    return sorted(map(tuple, got), key=str)


ROWS = [(1, None), (2, ""), (3, " "), (4, "Hello, world! <|endoftext|> <s> <0x41> <unk>"), (5, "naïve café\n\n  übergroß"),
        (6, "日本語のテキスト 🙂🙂"), (7, "\ttab  and   spaces  "), (7, "same key"), (None, "no key"), (None, "no key"),
        (8, "a ▁ b"), (9, "x\x00y z ﬁ Å"), (10, "don't we'll I'VE 12345 3.14"), (11, "word " * 300)]


def test_edges(spark, encoders):
    got = run(spark, ROWS)
    assert got == brute(encoders, ROWS)
    assert len(got) == len(ROWS) and any(r[3] for r in got)


@pytest.mark.parametrize("frequent", [0, 3, 40])
def test_rare_pairs_by_the_shuffled_join(spark, encoders, frequent):
    assert run(spark, ROWS, frequent=frequent) == brute(encoders, ROWS)


def test_long_texts_are_cut(spark, encoders):
    rng = random.Random(2)
    words = ["alpha", "Beta!", "(gamma)", "δέλτα", "12", "x" * 300, "\n", "\t\tq", "日本"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ""]) for _ in range(n)))
            for i, n in enumerate([30_000, 20])]
    got = run(spark, rows)
    for (key, *_, digest), (_, text) in zip(got, rows):
        a, b = tokens(encoders, text)
        assert (got[key][1], got[key][2]) == (len(a), len(b)) and digest
    pair = alignment.Pair(open(A, "rb").read(), open(B, "rb").read())
    text = rows[0][1]
    assert len(text) > 100_000 and pair._cut
    keep, a, b = pair.encode([text])
    assert keep.all() and a.ids.tolist() == [i for i, _ in tokens(encoders, text)[0]]
    assert b.ids.tolist() == [i for i, _ in tokens(encoders, text)[1]]


def test_overlaps(spark, encoders):
    rows = [(1, "internationalization of naïve tokens"), (2, None), (3, "日本語 x")]
    got = sorted(map(tuple, alignment.overlaps(spark.createDataFrame(rows, "doc_id int, text string"), A, B).collect()))
    want = []
    for key, text in rows:
        a, b = tokens(encoders, text) if text else ([], [])
        at = []
        for side in (a, b):
            e = 0
            at.append([(e, e := e + len(x)) for _, x in side])
        want += [(key, i, j, a[i][0], b[j][0], x[1] == y[1]) for i, x in enumerate(at[0]) for j, y in enumerate(at[1])
                 if x[0] < y[1] and y[0] < x[1]]
    assert got == sorted(want)


def test_text_of_the_groups(spark, encoders):
    row = alignment.align(spark.createDataFrame([(1, "naïve")], "doc_id int, text string"), A, B, groups="text").first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == brute(encoders, [(1, "naïve")])[0][-1]


def test_empty_table_and_clashing_names(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([("k", "some text", 1, "p")], "doc_id string, text string, row int, pairs string")
    assert [r.key for r in alignment.align(df, A, B).collect()] == ["k"]


def test_sf001_documents(spark, encoders):
    from souq.llm.queries import op13_token_alignment

    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    rows_short = [r for r in rows if len(r[1] or "") < 20_000]
    got = sorted(map(tuple, op13_token_alignment(spark, path).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)
    assert len(got) == len(rows) and len(rows_short) == len(rows)
    assert got == brute(encoders, rows)
