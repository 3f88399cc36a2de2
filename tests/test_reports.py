from datetime import datetime as dt
from decimal import Decimal as D

from souq.operators import reports as rp


def test_verified_reviews_repeat_purchases(spark):
    reviews = spark.createDataFrame([(1, 7, 100), (2, 7, 101), (3, 8, 100)],
                                    "review_id long, user_id long, product_id long")
    orders = spark.createDataFrame([(1, 7), (2, 7), (3, 9)], "order_id long, user_id long")
    items = spark.createDataFrame([(1, 100), (2, 100), (3, 101)], "order_id long, product_id long")
    got = {r.review_id: r.verified_purchase for r in rp.verified_reviews(reviews, orders, items).collect()}
    assert got == {1: True, 2: False, 3: False}          # bought twice, still one row


def test_orders_sellers_and_reconciliation(spark):
    orders = spark.createDataFrame(
        [(1, 7, "delivered", "paid", D("10.00"), D("0"), D("0"), D("0"), D("10.00"), dt(2024, 1, 1)),
         (2, 7, "pending", "pending", D("5.00"), D("1.00"), D("0"), D("0"), D("6.00"), dt(2024, 2, 1)),
         (3, 8, "pending", "pending", D("4.00"), D("0"), D("0"), D("0"), D("3.00"), dt(2024, 3, 1))],
        "order_id long, user_id long, order_status string, payment_status string, subtotal decimal(10,2), "
        "shipping_cost decimal(10,2), tax_amount decimal(10,2), discount_amount decimal(10,2), "
        "total_amount decimal(10,2), created_at timestamp_ntz")
    items = spark.createDataFrame(
        [(1, 1, 100, 50, 2, D("10.00"), "delivered"), (2, 2, 100, 50, 1, D("5.00"), "shipped"),
         (3, 3, 101, 51, 1, D("4.00"), "returned")],
        "order_item_id long, order_id long, product_id long, business_id long, quantity int, "
        "total_amount decimal(10,2), status string")
    hist = {r.user_id: (r.orders, r.total_spent, r.order_lines) for r in rp.order_history(orders, items).collect()}
    assert hist == {7: (2, D("16.00"), 2), 8: (1, D("3.00"), 1)}
    rec = {r.order_id: (r.items_gap, r.total_gap) for r in rp.order_reconciliation(orders, items).collect()}
    assert rec == {3: (D("0.00"), D("-1.00"))}
    sales = {r.business_id: (r.revenue, r.units, r.orders) for r in rp.seller_sales(items).collect()}
    assert sales == {50: (D("15.00"), 3, 2)}             # the returned line is excluded
    products = spark.createDataFrame([(100,), (101,), (102,)], "product_id long")
    ts = {r.product_id: r.total_sales for r in rp.refresh_total_sales(products, items).collect()}
    assert ts == {100: 3, 101: 0, 102: 0}


def test_unread_counts_and_wishlist(spark):
    msgs = spark.createDataFrame([(1, 2, 0), (2, 2, 1), (3, 3, 0)], "message_id long, receiver_id long, is_read int")
    notes = spark.createDataFrame([(1, 2, 0), (2, 4, 0)], "notification_id long, user_id long, is_read int")
    got = {r.user_id: (r.unread_messages, r.unread_notifications) for r in rp.unread_counts(msgs, notes).collect()}
    assert got == {2: (1, 1), 3: (1, 0), 4: (0, 1)}
    wl = spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, 1, 11)], "wishlist_id long, user_id long, product_id long")
    prods = spark.createDataFrame([(10, "A"), (11, "B")], "product_id long, name string")
    assert [(r.product_id, r.wishes) for r in rp.wishlist_popularity(wl, prods, k=1).collect()] == [(10, 2)]


def test_product_detail_with_attributes_and_tags(spark):
    products = spark.createDataFrame([(1, "A"), (2, "B")], "product_id long, name string")
    images = spark.createDataFrame([(1, 1, "a.jpg", True, 0)],
                                   "image_id long, product_id long, image_path string, is_primary boolean, display_order int")
    revs = spark.createDataFrame([(1, 1, 4)], "review_id long, product_id long, rating int")
    attrs = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "attribute_id long, product_id long")
    tags = spark.createDataFrame([(1, 2)], "tag_id long, product_id long")
    got = {r.product_id: (r.image_count, r.primary_image, str(r.avg_rating), r.review_count, r.attribute_count,
                          r.tag_count) for r in rp.product_detail(products, images, revs, attrs, tags).collect()}
    assert got == {1: (1, "a.jpg", "4.0", 1, 2, 0), 2: (0, None, "0.0", 0, 1, 1)}
