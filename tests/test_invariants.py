
import os

import pytest
from pyspark.sql import functions as F

from souq.operators import catalog, discovery, integrity, intake
from souq.plans import candidates
from souq.plans.registry import MAPPED_TABLES
from souq.sources.views import MarketViews

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def v(spark):
    return MarketViews(spark, SF)


def test_business_counts_add_up(v):
    counts = discovery.business_product_counts(v.businesses, v.products)
    total = counts.agg(F.sum("product_count")).first()[0]
    assert total == v.products.join(v.businesses.select("business_id"), "business_id", "left_semi").count()


def test_intake_partitions_the_input(v):
    cand = candidates.product_candidates(v)
    val = intake.validate_products(cand)
    ok = val.where(F.size("errors") == 0).count()
    bad = val.where(F.size("errors") > 0).count()
    assert ok + bad == cand.count() and ok > 0 and bad > 0


def test_pages_partition_each_seller(v):
    f = catalog.catalog_filter(v.products, v.categories)
    pages = [catalog.catalog_pages_all(v.products, v.categories, page=n) for n in range(1, 40)]
    seen = [(r.business_id, r.product_id) for p in pages for r in p.select("business_id", "product_id").collect()]
    assert len(seen) == len(set(seen)) == f.count()


def test_delete_plan_leaves_no_new_orphans(v):
    tables = {t: v.table(t) for t in MAPPED_TABLES}
    victims = v.users.where(~F.col("is_verified")).select("user_id")
    plan = integrity.plan_delete(tables, "users", victims)
    assert plan.where("NOT blocked").count() > 0 and plan.where("blocked").count() > 0
    before = {(r.child_table, r.child_column): r.orphan_rows for r in integrity.orphan_audit(tables).collect()}
    after = {(r.child_table, r.child_column): r.orphan_rows
             for r in integrity.orphan_audit(integrity.surviving_rows(tables, plan)).collect()}
    assert after == before
