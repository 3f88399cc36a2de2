import os

import pytest

from souq.operators import discovery
from souq.plans.sql import register_views
from souq.sources.views import MarketViews

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_sql_over_registered_views(spark):
    v = MarketViews(spark, SF)
    register_views(v, prefix="mk_")
    counts = spark.sql("""
        SELECT b.business_id, COUNT(p.product_id) AS product_count
        FROM mk_businesses b LEFT JOIN mk_products p ON b.business_id = p.business_id
        GROUP BY b.business_id""")
    want = discovery.business_product_counts(v.businesses, v.products).select("business_id", "product_count")
    assert sorted(counts.collect()) == sorted(want.collect())
    newest = spark.sql("""
        SELECT p.product_id, b.business_name,
               (SELECT i.image_path FROM mk_product_images i
                WHERE i.product_id = p.product_id AND i.is_primary LIMIT 1) AS image
        FROM mk_products p JOIN mk_businesses b ON p.business_id = b.business_id
        ORDER BY p.created_at DESC, p.product_id LIMIT 8""").collect()
    ref = discovery.newest_products(v.products, v.businesses, v.product_images, k=8).collect()
    assert [(r.product_id, r.business_name, r.image) for r in newest] == \
        [(r.product_id, r.business_name, r.image) for r in ref]
