from fixtures import tables

from souq.operators import catalog as cat
from souq.operators import taxonomy as tax
from souq.sources import seeds


def test_seed_tree(spark):
    roots = seeds.root_categories(spark)
    full = tax.add_children_by_parent_slug(roots, seeds.child_category_seed(spark))
    assert full.count() == 18
    tree = {r.category_name: [c.category_name for c in r.children]
            for r in tax.category_tree(full, order_by_name=True).collect()}
    assert len(tree) == 9
    assert tree["Electronics"] == ["Audio", "Laptops", "Smartphones"]
    assert tree["Fashion"] == ["Kids", "Men", "Women"]
    assert tree["Grocery"] == ["Bakery", "Dairy", "Fresh Produce"]
    assert tree["All Categories"] == []
    assert full.where("parent_id is not null").join(full.selectExpr("category_id as parent_id"),
                                                     "parent_id", "left_anti").count() == 0


def test_unknown_parent_slug_adds_nothing(spark):
    roots = seeds.root_categories(spark)
    kids = spark.createDataFrame([("X", "x", None, None, "nowhere", 1, 1)], seeds.child_category_seed(spark).schema)
    assert tax.add_children_by_parent_slug(roots, kids).count() == 9


def test_roots_zero_rule_and_filter_fallback(spark):
    t = tables(spark)
    c = t["categories"]
    assert sorted(r.category_id for r in tax.roots(c).collect()) == [1, 2, 3]
    assert sorted(r.category_id for r in tax.roots(c, zero_is_root=False).collect()) == [1, 3]
    p = t["products"]
    ids = lambda df: sorted(r.product_id for r in df.collect())
    assert ids(tax.filter_by_category(p, c, 1)) == [1, 2, 3, 5]       # self or one level of children
    assert ids(tax.filter_by_category(p, c, 2)) == [4]
    assert ids(tax.filter_by_category(p, c, 99)) == [6]               # empty lookup: equality fallback
    assert ids(tax.filter_by_category(p, c, 0)) == [1, 2, 3, 4, 5, 6]  # 0 means no filter
    counts = {r.category_id: r.product_count for r in tax.category_product_counts(p, c).collect()}
    assert counts[1] == 4 and counts[3] == 0 and counts[11] == 3


def test_catalog_search_and_paging(spark):
    t = tables(spark)
    p, c = t["products"], t["categories"]
    ids = lambda df: [r.product_id for r in df.collect()]
    # '%' and '_' stay wildcards: '100%' matches 'cotton 100%'; 'h_ne' matches phone names
    assert ids(cat.catalog_filter(p, c, search="100%")) == [3]
    assert sorted(ids(cat.catalog_filter(p, c, search="H_NE"))) == [1, 2]
    assert len(ids(cat.catalog_filter(p, c, search="0"))) == 6         # '0' is empty in PHP
    assert len(ids(cat.catalog_filter(p, c, search="  "))) == 6
    pages = [ids(cat.catalog_page(p, c, business_id=1, page=n, page_size=2)) for n in (0, 1, 2, 3)]
    assert pages[0] == pages[1] == [2, 6]                                # page floor is 1
    assert pages[2] == [1] and pages[3] == []
    one = cat.catalog_page(p, c, business_id=1, page=2, page_size=2).first()
    assert one.category_name == "phones"
    unknown = cat.catalog_page(p, c, business_id=1, page=1, page_size=2).collect()
    assert [r.category_name for r in unknown] == ["phones", None]       # category 99 unknown
    cnt = cat.catalog_count(p, c, business_id=1, page_size=2).first()
    assert (cnt.total_products, cnt.total_pages) == (3, 2)
    allp = cat.catalog_pages_all(p, c, page=1, page_size=2).collect()
    assert sorted((r.business_id, r.page_position, r.product_id) for r in allp) == \
        [(1, 1, 2), (1, 2, 6), (2, 1, 4), (2, 2, 3), (9, 1, 5)]
    counts = {r.business_id: (r.total_products, r.total_pages)
              for r in cat.catalog_counts_all(t["businesses"], p, c, search="red").collect()}
    assert counts == {1: (1, 1), 2: (1, 1), 3: (0, 0), 4: (0, 0)}


def test_page_union_is_the_filtered_set(spark):
    t = tables(spark)
    p, c = t["products"], t["categories"]
    seen = []
    for n in range(1, 4):
        seen += [r.product_id for r in cat.catalog_page(p, c, business_id=1, page=n, page_size=1).collect()]
    assert sorted(seen) == sorted(r.product_id for r in cat.catalog_filter(p, c, business_id=1).collect())
    assert len(seen) == len(set(seen))


def test_accent_insensitive_search(spark):
    df = spark.createDataFrame([(1, "Crème brûlée", None)], "product_id long, name string, description string")
    assert df.where(cat.search_predicate("CREME", accent_insensitive=True)).count() == 1
    assert df.where(cat.search_predicate("CREME")).count() == 0


def test_example_accounts_only_when_absent(spark):
    users = spark.createDataFrame([(5, "admin"), (6, "customer")], "user_id long, role string")
    biz = spark.createDataFrame([(3, 6)], "business_id long, user_id long")
    add_u, add_b = seeds.missing_example_accounts(spark, users, biz)
    u = add_u.collect()
    assert [(r.username, r.role, r.user_id) for r in u] == [("business", "business_owner", 8)]
    b = add_b.collect()
    assert [(r.business_id, r.user_id, r.business_name) for r in b] == [(4, 8, "Local Store")]
    none_u, none_b = seeds.missing_example_accounts(
        spark, users.unionByName(spark.createDataFrame([(9, "business_owner")], "user_id long, role string")), biz)
    assert none_u.count() == 0 and none_b.count() == 0


def test_search_with_separate_text_table(spark):
    t = tables(spark)
    p = t["products"].drop("description")
    text = t["products"].select("product_id", "description")
    got = sorted(r.product_id for r in cat.search_products(p, "red", text).collect())
    assert got == [1, 3]                                  # 1 and 3 match by name (1 also by text)
    got = sorted(r.product_id for r in cat.search_products(p, "_bread", text).collect())
    assert got == [4]                                     # text-only match, '_' a wildcard
    page = cat.catalog_page(p, t["categories"], business_id=2, search="cotton", product_text=text).collect()
    assert [(r.product_id, r.description) for r in page] == [(3, "cotton 100%")]


def test_like_pattern_backslashes(spark):
    assert cat.like_pattern("a\\%b") == "%a\\%b%"
    assert cat.like_pattern("a\\bc") == "%abc%"          # Spark would reject '\\b'
    assert cat.like_pattern("end\\") == "%end\\\\%"
    df = spark.createDataFrame([(1, "50% off", None), (2, "C:\\dir", None), (3, "abc", None)],
                               "product_id long, name string, description string")
    ids = lambda q: sorted(r.product_id for r in df.where(cat.search_predicate(q)).collect())
    assert ids("0\\%") == [1] and ids("a\\bc") == [3] and ids("C:\\\\d") == [2] and ids(":\\") == [2]


def test_seller_catalog_request_and_catalog_contract(spark):
    from souq.sources import dialect
    t = tables(spark)
    r = cat.seller_catalog(t["products"], t["categories"], business_id=1, page=1, page_size=2)
    assert (r["count"].first().total_products, r["count"].first().total_pages) == (3, 2)
    assert [x.product_id for x in r["page"].collect()] == [2, 6]
    t["products"].createOrReplaceTempView("products")
    rep = dialect.schema_contract(spark)
    assert sorted(x.missing_column for x in rep.collect()) == ["discount", "image"]
    spark.catalog.dropTempView("products")
    assert dialect.schema_contract(spark).first().missing_column is None
