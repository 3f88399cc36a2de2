"""Physical-plan properties the design relies on (checked on the smallest driver tables)."""

import os
import re

import pytest

import __spark_entry__ as E
from souq.operators import discovery
from souq.plans.registry import QUERIES
from souq.sources.views import MarketViews

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_lazy(spark):
    v = MarketViews(spark, SF)
    t = [v.products, v.businesses, v.product_images, v.product_text]      # reads the footers
    spark.sparkContext.setJobGroup("build-top-k", "top-k")
    try:
        frames = [discovery.top_deals(*t), discovery.newest_products(*t), discovery.trending(*t),
                  discovery.newest_businesses(t[1], t[0])]
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build-top-k")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for df in frames:                                                     # the whole query is in the plan
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in p and "l_partkey" in p


@pytest.mark.parametrize("name", ["top_deals", "newest_products", "trending_sample"])
def test_top_k_reduces_texts_by_a_semi_join(spark, name):
    p = E.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(re.match(r"[ :+-]*", x).group()) for x in p]
    text = next(i for i, x in enumerate(p) if "Relation" in x and "text#" in x)
    above = [p[i] for i in range(text) if depth[i] < depth[text] and "Join" in p[i]]
    assert "LeftSemi" in above[-1]


def test_per_seller_pages_limit_before_the_shuffle(spark):
    p = plan(spark, "catalog_page")
    assert "WindowGroupLimit" in p and ", Partial" in p


def test_search_does_not_move_texts(spark):
    p = plan(spark, "catalog_count")
    # the text predicate is evaluated in the documents scan ...
    assert re.search(r"FileScan parquet \[doc_id#\d+L,text#\d+\].*DataFilters: \[[^\]]*Contains\(lower\(text", p)
    # ... and no exchange carries the text column
    for line in p.splitlines():
        if "Exchange" in line:
            assert "text#" not in line


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_cartesians_or_python(spark, name):
    p = plan(spark, name)
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p, bad


@pytest.mark.parametrize("name", ["top_deals", "newest_products", "trending_sample", "seller_page", "catalog_page"])
def test_lineitem_is_read_once(spark, name):
    df = E.queries()[name](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_partkey", final)) == 1


def test_the_orphan_audit_reads_every_table_once_and_joins_no_keys(spark):
    p = plan(spark, "orphans").split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_partkey", p)) == 2      # order items, and the rollup of products
    assert len(re.findall(r"FileScan parquet \[[^\]]*o_orderkey", p)) == 1
    assert "SortMergeJoin [k" not in p and "LeftAnti" not in p
