"""Text keys, clashing columns and bad changes in the older operators."""

import pytest

from souq.llm import decontamination, license_scan, line_dedup, token_rollup
from souq.llm.queries import TOKENIZER


def test_line_dedup_with_text_keys(spark):
    line = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("b", f"x\n{line}"), ("a", line), (None, line)], "doc_id string, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert got["a"] == line and got["b"] == "x" and not got[None]


def test_license_scan_with_text_keys(spark):
    text = license_scan.TEMPLATES["MIT"] if "MIT" in license_scan.TEMPLATES else next(iter(license_scan.TEMPLATES.values()))
    got = license_scan.scan(spark.createDataFrame([("k", text), (None, text), ("z", None)], "doc_id string, text string")).collect()
    assert {r.key for r in got} == {"k", None}


def test_decontamination_with_text_item_ids(spark):
    question = "which planet of the solar system has the largest number of known moons today"
    docs = spark.createDataFrame([("d", f"{question} saturn"), ("e", "nothing here at all")], "doc_id string, text string")
    bench = spark.createDataFrame([(f"item {i}", f"{question} saturn" if i == 0 else f"other words number {i} entirely {i}")
                                   for i in range(30)], "item_id string, text string")
    got = decontamination.contamination(docs, bench).collect()
    assert {(r.key, r.item_id) for r in got} == {("d", "item 0")}


def _rollup(spark, tmp_path):
    return token_rollup.TokenRollup(spark, str(tmp_path / "r"), TOKENIZER, "bpe")


def _docs(spark, rows, op):
    return spark.createDataFrame(rows, f"doc_id int, text string, source string, lang string, {op} string")


def test_a_column_named_op_is_not_read_unless_named(spark, tmp_path):
    r = _rollup(spark, tmp_path)
    rows = [(1, "one two", "s", "en", "delete"), (2, "three", "s", "en", None), (3, "four five six", "s", "en", "x")]
    r.commit("a", _docs(spark, rows, "op"))
    got = {t.version: (t.docs, t.tokens) for t in r.totals().collect()}
    assert got["words"] == (3, 6) and got["bpe"][0] == 3 and got["bpe"][1] >= 6


@pytest.mark.parametrize("op", ["DELETE", None, "other"])
def test_unknown_changes_are_errors(spark, tmp_path, op):
    r = _rollup(spark, tmp_path)
    with pytest.raises(Exception, match="a change is one of"):
        r.commit("a", _docs(spark, [(1, "one", "s", "en", op)], "what"), op="what")
    assert r.committed() == []


def test_any_batch_name(spark, tmp_path):
    r = _rollup(spark, tmp_path)
    names = ["a/b", "..", "*?[x]{y}", "_hidden", "50%", "ü b"]
    for i, n in enumerate(names):
        assert r.commit(n, _docs(spark, [(i, "one", "s", "en", "insert")], "what"), op="what")
    assert r.committed() == sorted(names) and not r.commit("..", _docs(spark, [(9, "one", "s", "en", "insert")], "what"))
    assert {t.docs for t in r.totals().collect()} == {len(names)}
