"""Totals kept by signed changes, order history, detail lists."""

import random

import pytest
from pyspark.sql import functions as F

from souq.operators import history, reports, reviews, rollups


def _reviews(spark, rows):
    return spark.createDataFrame(rows, "review_id bigint, product_id bigint, rating int")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches_equal_recomputation(spark, tmp_path, seed):
    rng = random.Random(seed)
    products = spark.createDataFrame([(i,) for i in range(8)], "product_id bigint")
    rollup, now, done = rollups.rating_rollup(spark, str(tmp_path / "r")), {}, []
    new = lambda i: (i, rng.randrange(7), rng.choice([None, 1, 2, 5]))
    for batch in range(5):
        signed = []
        for i in rng.sample(sorted(now), min(len(now), 6)):
            signed.append((*now[i], -1))
            if rng.random() < .5:
                now[i] = new(i)
                signed.append((*now[i], 1))
            else:
                del now[i]
        for i in range(batch * 20, batch * 20 + rng.randrange(20)):
            now[i] = new(i)
            signed.append((*now[i], 1))
        rows = spark.createDataFrame(signed, "review_id bigint, product_id bigint, rating int, sign int")
        done.append((rows, str(batch)))
        rollup.commit(rows, str(batch))
        rollup.commit(*rng.choice(done))               # any earlier batch runs again
        if rng.random() < .4:
            rollup.compact()
        want = sorted(map(tuple, reviews.product_ratings(products, _reviews(spark, list(now.values()))).collect()))
        assert sorted(map(tuple, rollups.ratings(rollup, products).collect())) == want


def test_changes_and_bad_signs(spark, tmp_path):
    rollup = rollups.rating_rollup(spark, str(tmp_path / "r"))
    old, new = _reviews(spark, [(1, 1, 4)]), _reviews(spark, [(1, 2, 5)])
    rollup.commit(old.withColumn("sign", F.lit(1)), "load")
    rollup.commit(rollups.changes(old, new), "moved to another product")
    assert [(r.product_id, r.rows, r.rating_sum) for r in rollup.totals().collect()] == [(2, 1, 5)]
    for sign in (0, 2, None):
        with pytest.raises(Exception, match="sign"):
            rollup.commit(old.withColumn("sign", F.lit(sign).cast("int")), f"bad {sign}")
    rollup.compact()
    assert rollup.table.read().count() == 1


def test_null_keys_are_a_key(spark, tmp_path):
    rollup = rollups.sales_rollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([(None, 2, "shipped", 1), (None, 3, "returned", 1), (1, 5, "shipped", 1)],
                                 "product_id bigint, quantity int, status string, sign int")
    rollup.commit(rows, "a")
    assert {(r.product_id, r.rows, r.units) for r in rollup.totals().collect()} == {(None, 2, 2), (1, 1, 5)}


def test_history_needs_no_shuffle(spark, tmp_path):
    orders = spark.createDataFrame([(i, i % 7 if i % 3 else 1, f"2024-01-{1 + i % 5:02d}", "pending", "paid", 10) for i in range(200)],
                                   "order_id bigint, user_id bigint, created_at string, order_status string, "
                                   "payment_status string, total_amount int")
    items = spark.createDataFrame([(i % 150, 1 + i % 3) for i in range(400)], "order_id bigint, quantity int")
    stored = history.store_history(orders, items, "history_test", str(tmp_path / "h"), buckets=4)
    pages = history.order_pages(stored)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    want = {}
    for r in sorted(orders.collect(), key=lambda r: (r.order_id,)):
        want.setdefault(r.user_id, []).append(r)
    got = {(r.user_id, r.position): (r.order_id, r.order_lines) for r in pages.collect()}
    assert len(got) == 200
    lines = {}
    for r in items.collect():
        lines[r.order_id] = lines.get(r.order_id, 0) + 1
    for u, rows in want.items():
        rows.sort(key=lambda r: ([-ord(c) for c in r.created_at], r.order_id))
        assert [got[u, i + 1] for i in range(len(rows))] == [(r.order_id, lines.get(r.order_id, 0)) for r in rows]
    second = history.order_pages(stored, page=2, page_size=3)
    assert {(r.user_id, r.position) for r in second.collect()} == {(u, p) for u, v in want.items() for p in (4, 5, 6) if p <= len(v)}
    one = history.order_pages(stored.where("user_id = 1"))
    assert "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE history_test")


def test_detail_lists_page_on(spark):
    images = spark.createDataFrame([(i, 1, f"p{i}", i % 2 == 0, 9 - i) for i in range(9)],
                                   "image_id bigint, product_id bigint, image_path string, is_primary boolean, display_order int")
    attributes = spark.createDataFrame([(1, 1, "size", "XL", None)],
                                       "attribute_id bigint, product_id bigint, attribute_name string, attribute_value string, display_order int")
    tags = spark.createDataFrame([(3, 2, "new")], "tag_id bigint, product_id bigint, tag_name string")
    rows = lambda page: sorted((r.product_id, r.kind, r.position, r.value, r.total) for r in
                               reports.product_detail_lists(images, attributes, tags, page, 4).collect())
    assert rows(1) == [(1, "attribute", 1, "XL", 1), *[(1, "image", i + 1, f"p{8 - i}", 9) for i in range(4)], (2, "tag", 1, "new", 1)]
    assert rows(3) == [(1, "image", 9, "p0", 9)]
    plan = reports.product_detail_lists(images, attributes, tags)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
