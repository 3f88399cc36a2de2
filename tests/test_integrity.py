import os
from decimal import Decimal as D

from pyspark.sql import functions as F

from souq.operators import integrity as ig
from souq.sources import dialect


def _tables(spark):
    return {
        "users": spark.createDataFrame([(1, "a", "a@x.com", "customer"), (2, "b", "A@X.com ", "admin"),
                                        (3, "c", "c@x.com", "superuser")],
                                       "user_id long, username string, email string, role string"),
        "businesses": spark.createDataFrame([(10, 1, "pending"), (11, 3, "active")],
                                            "business_id long, user_id long, status string"),
        "products": spark.createDataFrame([(100, 10, 5), (101, 10, 5), (102, 11, 5), (103, 99, 5)],
                                          "product_id long, business_id long, category_id long"),
        "orders": spark.createDataFrame([(1000, 1), (1001, 2)], "order_id long, user_id long"),
        "order_items": spark.createDataFrame([(1, 1000, 100, 10), (2, 1001, 101, 10), (2, 1001, 102, 11)],
                                             "order_item_id long, order_id long, product_id long, business_id long"),
    }


def test_orphans_and_keys(spark):
    t = _tables(spark)
    orph = {(r.child_table, r.child_column): (r.orphan_keys, r.orphan_rows) for r in ig.orphan_audit(t).collect()}
    assert orph[("products", "business_id")] == (1, 1)
    assert orph[("order_items", "product_id")] == (0, 0)
    assert ("products", "category_id") not in orph          # categories table absent
    keys = {(r.table_name, r.key_name): (r.duplicate_keys, r.excess_rows) for r in ig.key_audit(t).collect()}
    assert keys[("users", "email")] == (1, 1)                # case and trailing space collide
    assert keys[("order_items", "order_item_id")] == (1, 1)
    assert keys[("users", "user_id")] == (0, 0)
    enums = {(r.table_name, r.column_name): r.bad_rows for r in ig.enum_audit(t).collect()}
    assert enums[("users", "role")] == 1 and enums[("businesses", "status")] == 0


def test_null_and_length_audits(spark):
    t = {"users": spark.createDataFrame([(1, None, "x" * 51), (2, "b", "ok")],
                                        "user_id long, username string, first_name string"),
         "products": spark.createDataFrame([(1, D("123456789.99"))], "product_id long, price decimal(12,2)")}
    nulls = {(r.table_name, r.column_name): r.null_rows for r in ig.null_audit(t).collect()}
    assert nulls[("users", "username")] == 1 and nulls[("users", "user_id")] == 0
    lens = {(r.table_name, r.column_name): r.bad_rows for r in ig.length_audit(t).collect()}
    assert lens[("users", "first_name")] == 1 and lens[("products", "price")] == 1


def test_delete_plan_restrict_and_cascade(spark):
    t = _tables(spark)
    victims = t["users"].where("user_id in (1, 3)").select("user_id")
    plan = ig.plan_delete(t, "users", victims)
    rows = {(r.root_key, r.table_name, r.key, r.action): r.blocked for r in plan.collect()}
    # user 1: business 10 -> products 100, 101; order 1000 -> item 1 (deleted with the user).
    # item 2 belongs to user 2's order and references product 101 and business 10: RESTRICT blocks.
    assert rows[(1, "products", 101, "delete")] is True
    assert rows[(1, "order_items", 2, "restrict")] is True
    assert rows[(1, "order_items", 1, "delete")] is True
    # user 3: business 11 -> product 102, referenced by item 2 of someone else's order: blocked
    assert rows[(3, "products", 102, "delete")] is True
    # a referencing row deleted by the same cascade does not block
    only_own = ig.plan_delete({k: v for k, v in t.items()}, "orders",
                              t["orders"].where("order_id = 1000").select("order_id"))
    assert {r.blocked for r in only_own.collect()} == {False}
    survivors = ig.surviving_rows(t, only_own)
    assert survivors["orders"].count() == 1 and survivors["order_items"].count() == 2


def test_owned_delete(spark):
    t = _tables(spark)
    req = spark.createDataFrame([(100, 10), (103, 99), (100, 11), (7, 10)], "product_id long, business_id long")
    got = {(r.product_id, r.business_id): r.status for r in ig.owned_delete(t["products"], t["order_items"], req).collect()}
    assert got == {(100, 10): "blocked", (103, 99): "deleted", (100, 11): "not_owned", (7, 10): "not_owned"}
    classified = ig.owned_delete(t["products"], t["order_items"], req)
    assert sorted(r.product_id for r in ig.products_after_delete(t["products"], classified).collect()) == [100, 101, 102]


def test_dialects_and_migration(spark):
    both = spark.createDataFrame([(1, D("0"), D("5")), (2, D("3"), D("7")), (3, None, D("9"))],
                                 "id long, discount decimal(5,2), discount_percent decimal(5,2)")
    m = {r.id: r.discount for r in dialect.migrate_discount(both).collect()}
    assert m == {1: D("5.00"), 2: D("3.00"), 3: None}        # NULL = 0 is not true
    only_new = spark.createDataFrame([(1, D("4"))], "id long, discount_percent decimal(5,2)")
    assert dialect.migrate_discount(only_new).columns == ["id", "discount"]
    canon = dialect.resolve_columns(dialect.migrate_discount(both), "products")
    assert set(canon.columns) == {"product_id", "discount_percent"}
    rep = dialect.schema_contract(spark, {"products": both})
    assert sorted(r.missing_column for r in rep.collect()) == ["business_id", "category_id", "description",
                                                               "image", "name", "price"]
    assert dialect.schema_contract(spark, {}).first().missing_column is None


def test_dialect2_tables_run_through_the_operators(spark):
    from datetime import datetime as dt

    from souq.operators import catalog, discovery, taxonomy
    cats2 = spark.createDataFrame([(1, "Electronics", None), (2, "Phones", 1)], "id long, name string, parent_id long")
    prods2 = spark.createDataFrame(
        [(7, 3, 2, "Phone X", "desc", D("100.00"), D("0"), D("20"), "up/x.jpg", dt(2024, 1, 1))],
        "id long, business_id long, category_id long, name string, description string, price decimal(10,2), "
        "discount decimal(5,2), discount_percent decimal(5,2), image string, created_at timestamp_ntz")
    biz2 = spark.createDataFrame([(3, 30, "Shop")], "id long, user_id long, name string")
    cats = dialect.resolve_columns(cats2, "categories")
    prods = dialect.resolve_columns(dialect.migrate_discount(prods2), "products")
    biz = dialect.resolve_columns(biz2, "businesses")
    assert [r.product_id for r in taxonomy.filter_by_category(prods, cats, 1).collect()] == [7]
    page = catalog.catalog_page(prods, cats, business_id=3).first()
    assert page.category_name == "Phones" and page.discount_percent == D("20.00")
    images = prods.select("product_id", "image_path").withColumn("image_id", prods.product_id)
    deal = discovery.top_deals(prods, biz, images).first()
    assert (deal.business_name, deal.image, str(deal.discounted_price)) == ("Shop", "up/x.jpg", "80.00")


def test_sinks_append_and_snapshot(spark):
    import tempfile

    from souq.sources import sinks
    root = tempfile.mkdtemp(prefix="souq-sink-")
    t = _tables(spark)
    sinks.append(t["products"], root + "/products", partition_by=["category_id"])
    sinks.append(t["products"].limit(1), root + "/products", partition_by=["category_id"])
    assert spark.read.parquet(root + "/products").count() == 5
    req = spark.createDataFrame([(103, 99)], "product_id long, business_id long")
    after = ig.products_after_delete(t["products"], ig.owned_delete(t["products"], t["order_items"], req))
    sinks.write_snapshot(after, root + "/products_v2")
    assert sorted(r.product_id for r in spark.read.parquet(root + "/products_v2").collect()) == [100, 101, 102]


def test_column_audit_matches_the_separate_audits(spark):
    t = _tables(spark)
    t["users"] = t["users"].withColumn("first_name", F.lit("x" * 60))
    combined = {(r.table_name, r.column_name, r.check): r.bad_rows for r in ig.column_audit(t).collect()}
    for r in ig.null_audit(t).collect():
        assert combined[(r.table_name, r.column_name, "not_null")] == r.null_rows
    for r in ig.length_audit(t).collect():
        assert combined[(r.table_name, r.column_name, "length")] == r.bad_rows
    for r in ig.enum_audit(t).collect():
        assert combined[(r.table_name, r.column_name, "enum")] == r.bad_rows
    assert combined[("users", "first_name", "length")] == 3


def test_set_null_is_applied(spark):
    cats = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "category_id bigint, parent_id bigint")
    victims = spark.createDataFrame([(1,)], "category_id bigint")
    t = {"categories": cats}
    left = ig.surviving_rows(t, ig.plan_delete(t, "categories", victims))
    assert sorted(left["categories"].collect()) == [(2, None), (3, 2)]
    assert all(r["orphan_rows"] == 0 for r in ig.orphan_audit(left).collect())


def test_composite_text_key_counts_every_part(spark):
    t = {"cart_items": spark.createDataFrame([(1, "u1", "p1"), (2, "u1", "p2"), (3, "u1", "p2")],
                                             "cart_item_id bigint, user_id string, product_id string")}
    got = {r["key_name"]: (r["duplicate_keys"], r["excess_rows"]) for r in ig.key_audit(t).collect()}
    assert all(v == (1, 1) for k, v in got.items() if "," in k)


def test_key_sums_beyond_38_digits(spark):
    top = 10 ** 38 - 1
    for keys in ([], [None], [0], [7, None, 8], [top, top, top], [-top, -top], [top, -top], [10 ** 20, -1], [-10 ** 20, 1],
                 [10 ** 20 - 1, 1], [-5], [10 ** 20], [123 * 10 ** 20 + 45, -10 ** 20]):
        df = spark.createDataFrame([(None if k is None else D(k),) for k in keys], "k decimal(38,0)")
        want = [k for k in keys if k is not None]
        assert df.agg(ig.key_sum("k").alias("s")).first().s == (str(sum(want)) if want else None), keys
    assert spark.createDataFrame([(2 ** 63 - 1,), (2 ** 63 - 1,)], "k bigint").agg(
        ig.key_sum("k").alias("s")).first().s == str(2 ** 64 - 2)


def test_delete_survivors_of_long_order_keys(spark, tmp_path):
    """Packed keys of order lines have 38 digits here: their sum has more."""
    from souq.plans import registry
    for f in os.listdir("/root/testdata/sf0.001"):
        if f != "lineitem.parquet":
            os.symlink(f"/root/testdata/sf0.001/{f}", tmp_path / f)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows_ = [{**lines.first().asDict(), "l_orderkey": 9 * 10 ** 12 + i, "l_linenumber": 1, "l_partkey": 1, "l_suppkey": 1}
             for i in range(3)]
    spark.createDataFrame(rows_, lines.schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    d = str(tmp_path)
    got = {r.table_name: r for r in registry.q_delete_survivors(spark, d).collect()}
    keys = [int(f"{r['l_orderkey']}1{1:012d}{1:012d}") for r in rows_]
    assert (got["order_items"].rows, got["order_items"].key_sum) == (3, str(sum(keys)))
