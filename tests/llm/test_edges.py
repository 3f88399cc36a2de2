"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import os

import pytest

import corpus_pipeline
from souq.llm import (class_lm, decontamination, html_wrappers, jaccard_join, license_scan, line_dedup, mixing,
                      quality_rules, suffix_dedup, token_rollup)
from souq.llm.common import work_folder
from souq.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `key` string, `text 2` int, copies int"
PROSE = "A quiet line of prose ends here. Another one follows it, as it should.\n"
LONG = " ".join(f"word{i}" for i in range(30_000)) + "."
TEXTS = [(1, PROSE * 3, "en", "a"), (1, PROSE * 3, "en", "a"), (2, None, None, None), (None, PROSE * 3, "en", None),
         (3, "", "en", "a"), (4, " \n\t\n ", "de", "b"), (5, LONG, "en", "b"), (6, LONG + " more.", "en", "b"),
         (7, "Licensed under the Apache License, Version 2.0.\n" + PROSE, None, "b"), (8, "x\x85y z w", "fr", ""),
         (9, "\n", "en", "a"), (10, "ß😀 " * 400, "en", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), "k", 1, 0) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bench(spark):
    return spark.createDataFrame([(1, "word100 word101 word102 word103 word104 word105. word106 word107"), (2, None),
                                  (3, ""), (None, "a b c")], "item_id bigint, text string")


PER_ROW = [("near", lambda s, d: jaccard_join.near_duplicates(d)), ("repeats", lambda s, d: suffix_dedup.repeats(d)),
           ("lm", lambda s, d: class_lm.score(d)), ("mix", lambda s, d: mixing.mix(d)),
           ("quality", lambda s, d: quality_rules.judge(d)), ("lines", lambda s, d: line_dedup.dedup(d)),
           ("bench", lambda s, d: decontamination.with_hits(d, bench(s)))]


@pytest.mark.parametrize("name,f", PER_ROW, ids=[n for n, _ in PER_ROW])
def test_every_row_has_a_result(spark, docs, empty, name, f):
    assert f(spark, docs).count() == len(TEXTS)
    assert f(spark, empty).count() == 0


def test_near_duplicates(spark, docs):
    got = {(r["key"], r["n_shingles"]): r["component"] for r in jaccard_join.near_duplicates(docs).collect()}
    assert got[(2, 0)] == 2 and got[(3, 0)] == 3 and got[(4, 0)] == 4
    assert {c for (k, n), c in got.items() if k in (5, 6)} == {5}
    assert [c for (k, _), c in got.items() if k is None] == [1]         # linked to document 1, of the same text
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_repeats(docs):
    got = {r["key"]: r for r in suffix_dedup.repeats(docs).collect()}
    assert got[2]["n_bytes"] == 0 and got[2]["n_removed"] == 0
    assert got[5]["n_removed"] >= got[5]["n_bytes"] - 1 and got[5]["n_spans"] == 1
    assert got[10]["n_removed"] == got[10]["n_bytes"]       # its period repeats at every place


def test_line_dedup(docs):
    out = line_dedup.dedup(docs, removed_lines="gone")
    assert out.columns == [*docs.columns, "gone"]
    got = out.collect()
    assert [r["text"] for r in got if r["doc_id"] == 2] == [None]
    first = [r for r in got if r["doc_id"] == 1]
    assert len(first) == 2 and first[0] == first[1]          # rows equal in key and text share their result
    assert all(r["text"] is None or r["gone"] or r["n_chars"] == len(r["text"]) for r in got)


def test_quality(docs):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert got[2]["q_n_words"] == 0 and got[2]["q_base_failed"] and not got[2]["q_kept"] and got[2]["q_clean"] is None
    assert got[5]["q_kept"] and got[5]["q_n_words"] == 30_000
    assert quality_rules.clean(docs).columns == docs.columns


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert {r["source"] for r in got} == {None, "", "a", "b", "c"}
    again = {(r["key"], r["size"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["key"], r["size"], r["taken"]) for r in got}
    assert mixing.sample(docs).columns[:-1] == docs.columns        # the copies column is taken: another name


def test_decontamination(spark, docs):
    hits = decontamination.contamination(docs, bench(spark)).collect()
    assert sorted((r["key"], r["item_id"]) for r in hits) == [(5, 1), (6, 1)]
    clean = decontamination.decontaminate(docs, bench(spark))
    assert clean.columns == docs.columns and clean.count() == len(TEXTS) - 2
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.decontaminate(docs, nothing).count() == len(TEXTS)


def test_decontamination_in_blocks_of_items(spark, docs):
    items = spark.createDataFrame([(i, " ".join(f"word{100 * i + j}" for j in range(12))) for i in range(40)],
                                  "item_id bigint, text string")
    whole = decontamination.contamination(docs, items).select("key", "item_id").collect()
    parts = decontamination.contamination(docs, items, index_bytes=1000).select("key", "item_id").collect()
    assert sorted(whole) == sorted(parts) and len(whole) == 80


def test_license_scan(spark, docs, empty):
    got = license_scan.scan(docs).collect()
    assert [(r["key"], r["line"], r["license"], r["exact"]) for r in got] == [(7, 0, "Apache-2.0", True)]
    assert license_scan.scan(empty).count() == 0
    near = spark.createDataFrame([(1, "Licensed under the strict Apache License, Version 2.0."),
                                  (2, "Licensed under the Apache License, Version 3.0."),
                                  (3, "We licensed nothing here, whatever the rest of this sentence says.")],
                                 "doc_id bigint, text string")
    got = {r["key"]: r for r in license_scan.scan(near).collect()}
    assert set(got) == {1} and got[1]["added"] == "strict" and not got[1]["exact"]


def test_token_rollup(spark, docs, empty):
    import tiktoken  # noqa: F401  (the vocabulary is read through it)
    t = token_rollup.TokenRollup(spark, work_folder(spark, "t"), TOKENIZER, "v1")
    total = lambda: {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in t.totals().collect()}
    assert t.commit("1", docs) and not t.commit("1", docs)
    first = total()
    assert first[("a", "en", "words")] == (3, 3 * 14)           # documents 1 (once), 3 and 9
    assert first[(None, None, "words")] == (1, 0)
    assert t.commit("2", empty) and total() == first
    change = spark.createDataFrame([(1, "one two", "en", "a", "revise", 1), (1, "one two three", "en", "a", "revise", 2),
                                    (3, None, None, None, "delete", 1), (99, None, None, None, "delete", 1),
                                    (11, "new words", "en", "n", "revise", 1)],
                                   "doc_id bigint, text string, lang string, source string, op string, seq int")
    assert t.commit("3", change, op="op", seq="seq")
    now = total()
    assert now[("a", "en", "words")] == (2, 3) and now[("n", "en", "words")] == (1, 2)
    assert t.committed() == ["1", "2", "3"]


def test_token_rollup_after_a_broken_batch(spark, docs):
    folder = work_folder(spark, "t")
    t = token_rollup.TokenRollup(spark, folder, TOKENIZER, "v1")
    t._mark = lambda batch: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        t.commit("1", docs)
    assert t.totals().count() == 0
    t = token_rollup.TokenRollup(spark, folder, TOKENIZER, "v1")
    assert t.commit("1", docs)
    assert sum(r["docs"] for r in t.totals().where("version = 'words'").collect()) == len(TEXTS) - 1


PAGE = ("<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><a href=/>m</a></nav>"
        "<div class='cookie-notice'>cookies</div><article><h1>H &amp; h</h1><p>one <b>two<br><p>x&#33; %s"
        "<form><input>f</form><aside>side</aside><div class=comments><p>reader</div></article>"
        "<div id=sidebar>s</div><footer>end</footer><script>var t='</p>';</script></body></html>")


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.example/1", PAGE % "first", "t"), (2, "http://a.example/2", PAGE % "second", "t"),
         (3, "http://a.example/3", None, "t"), (4, None, "", "t"), (5, "nonsense", "plain text", "t"),
         (6, "http://b.example/", "<div><p>" + "some words " * 60 + "</p></div><ul><li><a href=x>link</a></ul>", "t"),
         (1, "http://a.example/1", PAGE % "first", "t")], "page_id bigint, url string, html string, text string")
    out = html_wrappers.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 7
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[1] == "H & h\none two\nx! first" and got[2] == "H & h\none two\nx! second"
    assert got[3] == got[4] == got[5] == "" and got[6] == ("some words " * 60).strip()
    assert html_wrappers.extract(pages.limit(0)).count() == 0


def test_wrapper_expression():
    tree = html_wrappers.shape(html_wrappers.parse("<ul><li>a<li>b</ul><h2>x</h2><p>y</p><h2>z</h2><p>w</p>"))
    other = html_wrappers.shape(html_wrappers.parse("<ul><li>a</ul><hr><h2>x</h2><p>y</p>"))
    assert html_wrappers.expression(tree) == "<ul>(<li>#</li>)+</ul>(<h2>#</h2><p>#</p>)+"
    assert "(<hr/>)?" in html_wrappers.expression(html_wrappers.align(tree, other))


def test_pipeline_stages(spark, docs, empty):
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, empty):
            out = stage(spark, d, SF)
            last = name == corpus_pipeline.STAGES[-1][0]
            assert out.columns[:len(docs.columns)] == docs.columns and (last or out.columns == docs.columns)
            assert out.count() <= d.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"]
    rows = out.collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)
