"""Passages of over 50 words in several otherwise different documents: op5 shows them in n_removed, not in n_bytes."""

import hashlib
import random

import pytest

from souq.llm import queries, suffix_dedup

SIZE = 4000                        # bytes of every document
MARKS = "ABCDEFGH"                 # the bytes around a passage differ from document to document


def prose(rng, size):
    words = []
    while sum(map(len, words)) + len(words) < size:
        words.append("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9))))
    return " ".join(words)[:size - 1] + "."


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """(texts, what is left of each, results): documents with a long passage, with one a byte too short, and clean ones."""
    rng = random.Random(11)
    long, short = prose(rng, 700), prose(rng, suffix_dedup.LENGTH - 1)
    assert len(long.split()) > 50 and len(short.split()) > 50
    texts, left = {}, {}
    for k, passage in enumerate((long, short, "")):
        for i, mark in enumerate(MARKS):
            own = prose(rng, SIZE - len(passage) - 2)
            at = rng.randint(0, len(own))
            head, tail = own[:at] + mark, mark + own[at:]
            texts[100 * k + i] = head + passage + tail
            left[100 * k + i] = head + tail if passage == long else texts[100 * k + i]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return texts, left, {r["doc_id"]: r for r in queries.op5_suffix_dedup(spark, folder).collect()}


def test_planted_passages_are_removed_and_all_else_stays(case):
    texts, left, got = case
    assert got.keys() == texts.keys()
    for d, r in got.items():
        gone = len(texts[d]) - len(left[d])
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            gone, int(gone > 0), hashlib.sha256(left[d].encode()).hexdigest())
    assert {d for d, r in got.items() if r["n_removed"]} == set(range(len(MARKS)))


def test_sizes_of_the_input_do_not_tell_planted_from_clean(case):
    assert {r["n_bytes"] for r in case[2].values()} == {SIZE}
