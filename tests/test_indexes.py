"""Trigram index and rank index against scans."""

import random

import pytest
from pyspark.sql import functions as F

from souq.operators import catalog
from souq.operators.rank_index import RankIndex
from souq.operators.text_index import TextIndex, literal_parts, search_products

WORDS = ["red", "Redder", "über", "ÜBUNG", "100%", "a_b", "x", "日本語", "🙂🙂🙂", "o'clock", "back\\slash", "tab\tbed", "ΟΔΟΣ", "İz"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    rows = [(i * 3, rng.choice([" ", "", "\n"]).join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9)))) for i in range(300)]
    rows += [(1, None), (2, ""), (4, "re"), (4, "red"), (900, "re"), (901, "RED")]
    return spark.createDataFrame(rows, "id bigint, text string")


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    return TextIndex(spark, str(tmp_path_factory.mktemp("ix"))).add(texts, "id", "text", block=50)


def test_literal_parts():
    assert literal_parts("%ab_c%") == ["ab", "c"]
    assert literal_parts("%a\\%b\\_c\\\\%d") == ["a%b_c\\", "d"]
    assert literal_parts("%%") == []


PATTERNS = ["%red%", "%Red%", "%r_d%", "%red%über%", "%100\\%%", "%a\\_b%", "%a_b%", "red%", "%red", "red", "%日本語%",
            "%🙂🙂%", "%🙂🙂🙂%", "%o'c%", "%\\\\slash%", "%x%", "%%", "%", "_e_", "%no such text%", "%ΟΔΟΣ%", "%οδος%", "%İz%",
            "%tab\tbed%", "%redred%", "re"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_like_equals_the_scan(index, texts, pattern):
    want = sorted({r.id for r in texts.where(F.col("text").ilike(pattern)).collect()})
    assert sorted(r.id for r in index.like(pattern).collect()) == want


def test_random_searches_equal_the_scan(index, texts):
    rng = random.Random(1)
    rows = [r for r in texts.collect() if r.text]
    for _ in range(12):
        t = rng.choice(rows).text
        i = rng.randrange(len(t))
        q = "".join(rng.choice("%_") if rng.random() < .15 else c for c in t[i:i + rng.randrange(1, 8)])
        s = catalog.clean_search(q)
        want = sorted({r.id for r in texts.where(F.col("text").ilike(catalog.like_pattern(s))).collect()}) if s else []
        assert sorted(r.id for r in index.search(q).collect()) == want, q


def test_only_candidate_blocks_are_read(index):
    plan = index.like("%redder%")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert "PushedFilters: [In(gram" in index.postings.where(F.col("gram").isin(["red", "edd"]))._jdf.queryExecution() \
        .executedPlan().toString().replace("IsNotNull(gram), ", "")
    assert index.candidates("%xy%") is None and index.candidates("%zzzz%").count() == 0


def test_posting_lists_are_bounded_by_the_block(index):
    r = index.postings.agg(F.max("n"), F.count("*"), F.max(F.size("ids"))).first()
    assert r[0] <= 50 and r[1] > 50 and r[2] <= 50


def test_appended_texts_are_found(spark, tmp_path):
    ix = TextIndex(spark, str(tmp_path / "a"))
    ix.add(spark.createDataFrame([(1, "old lamp")], "k int, t string"), "k", "t")
    ix.add(spark.createDataFrame([(2, "new LAMP"), (3, "none")], "k int, t string"), "k", "t")
    assert sorted(r.id for r in ix.search("lamp").collect()) == [1, 2]


def test_products_by_name_or_text(spark, tmp_path):
    ix = TextIndex(spark, str(tmp_path / "a")).add(spark.createDataFrame([(1, "a red one"), (2, "blue")], "i int, t string"), "i", "t")
    p = spark.createDataFrame([(1, "x"), (2, "Redwood"), (3, "y")], "product_id bigint, name string")
    assert sorted(r.product_id for r in search_products(p, ix, " red ").collect()) == [1, 2]
    assert search_products(p, ix, "0").count() == 3


# -- rank index ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def products(spark):
    rng = random.Random(4)
    rows = [(i, 1 if i % 3 else rng.randrange(2, 6), f"2024-01-{1 + i % 9:02d} 00:00:00", f"p{i}") for i in range(400)]
    return spark.createDataFrame(rows, "product_id bigint, business_id bigint, created_at string, name string") \
                .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def test_every_page_of_every_seller(spark, products, tmp_path):
    ix = RankIndex(spark, str(tmp_path / "r")).build(products, parts=13)
    every = {}
    for r in products.collect():
        every.setdefault(r.business_id, []).append(r)
    totals = {r.business_id: (r.total_products, r.total_pages) for r in ix.counts().collect()}
    assert totals == {b: (len(v), -(-len(v) // 10)) for b, v in every.items()}
    for b, rows in every.items():
        rows.sort(key=lambda r: (-r.created_at.timestamp(), r.product_id))
        pages = {1, 2, totals[b][1], totals[b][1] + 1, *range(1, totals[b][1], 7)}
        for page in pages:
            got = [r.product_id for r in ix.page(b, page).collect()]
            assert got == [r.product_id for r in rows[(page - 1) * 10:page * 10]]
    assert ix.page(99).count() == 0 and ix.page(1, page=None).count() == 10


def test_a_deep_page_reads_its_parts_only(spark, products, tmp_path):
    ix = RankIndex(spark, str(tmp_path / "r")).build(products, parts=20)
    last = ix.counts().where("business_id = 1").first().total_pages
    df = ix.page(1, last)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "offset" not in plan.lower()
    assert len(df.inputFiles()) <= 20 and "PartitionFilters: [part" in plan.replace("isnotnull(part#", "part#")
    assert len({r.part for r in ix.index.where("business_id = 1").collect()}) > 3


def test_empty_catalog(spark, products, tmp_path):
    ix = RankIndex(spark, str(tmp_path / "r")).build(products.where("false"))
    assert ix.counts().count() == 0 and ix.page(1).count() == 0


def test_no_texts(spark, tmp_path):
    ix = TextIndex(spark, str(tmp_path / "a")).add(spark.createDataFrame([(1, None)], "k int, t string"), "k", "t")
    assert ix.search("lamp").count() == 0 and ix.like("%").count() == 0
