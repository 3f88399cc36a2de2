from decimal import Decimal as D

from souq.operators import reviews


def test_mean_rating_rounds_like_mysql_then_php(spark):
    products = spark.createDataFrame([(i,) for i in range(1, 7)], "product_id long")
    data = {1: [1, 2], 2: [1, 1, 2], 3: [5, 5, 5, 4], 4: [2, 3], 6: [1] * 7 + [2] * 13}
    rows = [(k * 100 + i, k, r, False) for k, rs in data.items() for i, r in enumerate(rs)]
    rev = spark.createDataFrame(rows, "review_id long, product_id long, rating int, is_hidden boolean")
    got = {r.product_id: (r.avg_rating, r.review_count) for r in reviews.product_ratings(products, rev).collect()}
    assert got[1] == (D("1.5"), 2)
    assert got[2] == (D("1.3"), 3)          # 1.3333
    assert got[3] == (D("4.8"), 4)          # 4.75 rounds half up
    assert got[4] == (D("2.5"), 2)
    assert got[5] == (D("0.0"), 0)          # no reviews
    assert got[6] == (D("1.7"), 20)         # 1.65 exactly: half up


def test_hidden_reviews(spark):
    products = spark.createDataFrame([(1,)], "product_id long")
    rev = spark.createDataFrame([(1, 1, 5, False), (2, 1, 1, True)],
                                "review_id long, product_id long, rating int, is_hidden boolean")
    assert reviews.product_ratings(products, rev).first().avg_rating == D("3.0")
    assert reviews.product_ratings(products, rev, exclude_hidden=True).first().avg_rating == D("5.0")
