from decimal import Decimal

from pyspark.sql import functions as F

from souq.functions import (business_category_label, date_label, discount_badge, discount_label,
                            discounted_price, home_price_label, html_escape, image_or_placeholder,
                            is_digits, is_valid_email, location_label, php_empty, seller_price_label,
                            slugify, to_float_prefix, to_int_prefix, truncate_text)


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first()["r"]


def test_slugify(spark):
    assert one(spark, slugify, "Hello World!") == "hello-world"
    assert one(spark, slugify, "a - b") == "a---b"          # hyphens are not collapsed
    assert one(spark, slugify, "--Café 9--") == "caf-9"
    assert one(spark, slugify, "!!!") == ""                   # reduces to empty (T-16)


def test_html_escape(spark):
    assert one(spark, html_escape, "  <a href=\"x\">Tom & Jerry's</a>\n") == \
        "&lt;a href=&quot;x&quot;&gt;Tom &amp; Jerry&#039;s&lt;/a&gt;"
    assert one(spark, html_escape, "&amp;") == "&amp;amp;"


def test_truncate_text(spark):
    assert one(spark, truncate_text, "short text") == "short text"
    long = "word " * 30
    out = one(spark, truncate_text, long)
    # first 100 bytes end with a space at byte 99, so 20 whole words survive
    assert out == ("word " * 20)[:99] + "..."
    assert one(spark, truncate_text, "x" * 150) == "..."     # no space: only the marker
    # byte semantics: 60 two-byte characters are 120 bytes, so the text is cut
    s = "é" * 40 + " " + "é" * 20
    assert one(spark, truncate_text, s) == "é" * 40 + "..."


def test_php_coercion(spark):
    assert one(spark, to_int_prefix, "12abc") == 12
    assert one(spark, to_int_prefix, "abc") == 0
    assert one(spark, to_int_prefix, "  -7x") == -7
    assert one(spark, to_int_prefix, None) == 0
    assert one(spark, to_int_prefix, "1e3kg") == 1000           # exponent: through the float
    assert one(spark, to_int_prefix, "12.9") == 12
    assert one(spark, to_float_prefix, "12.5kg") == 12.5
    assert one(spark, to_float_prefix, ".5") == 0.5
    assert one(spark, to_float_prefix, "1e3") == 1000.0
    assert one(spark, to_float_prefix, "x1") == 0.0
    assert one(spark, php_empty, "0") is True
    assert one(spark, php_empty, "") is True
    assert one(spark, php_empty, "00") is False


def test_email_and_phone(spark):
    assert one(spark, is_valid_email, "a.b+c@example.co.uk") is True
    for bad in ["a..b@x.com", ".a@x.com", "a.@x.com", "a@x", "a@-x.com", "no-at", None]:
        assert one(spark, is_valid_email, bad) is False, bad
    assert one(spark, is_digits, "0123") is True
    assert one(spark, is_digits, "12-3") is False


def test_money_labels(spark):
    df = spark.createDataFrame([(Decimal("19.99"), Decimal("12.50"))], "price decimal(10,2), pct decimal(5,2)")
    r = df.select(discounted_price("price", "pct").alias("d"), home_price_label("price").alias("h"),
                  seller_price_label("price").alias("s"), discount_label("pct").alias("l"),
                  discount_badge("pct").alias("b")).first()
    assert r.d == Decimal("17.49")                  # 19.99 * 0.875 = 17.49125
    assert r.h == "₹1,499.25" and r.s == "₹19.99"
    assert r.l == "13% OFF"                         # round half up
    assert r.b == "12.50% OFF"
    # number_format rounds half up where format_number alone would round half even (T-05)
    half = spark.createDataFrame([(Decimal("0.125"),)], "v decimal(10,3)")
    assert half.select(seller_price_label("v").alias("r")).first().r == "₹0.13"
    zero = spark.createDataFrame([(Decimal("0.00"),)], "pct decimal(5,2)")
    assert zero.select(discount_badge("pct").alias("b")).first().b == "-"


def test_lookup_labels(spark):
    assert one(spark, business_category_label, "food") == "Food & Beverages"
    assert one(spark, business_category_label, "nope") == "Unknown"
    assert one(spark, lambda c: business_category_label(c, badge=True), None) is None
    assert one(spark, image_or_placeholder, None) == "assets/images/product-placeholder.jpg"
    assert one(spark, image_or_placeholder, "") == ""          # ?? only replaces NULL
    df = spark.createDataFrame([("Pune", "MH"), ("Pune", None)], "c string, s string")
    assert [r.l for r in df.select(location_label("c", "s").alias("l")).collect()] == \
        ["Pune, MH", "Location not specified"]


def test_date_label(spark):
    df = spark.sql("select timestamp_ntz'2024-01-05 10:00:00' as v")
    assert df.select(date_label("v").alias("r")).first().r == "Jan 5, 2024"


def test_php_blank_matches_empty_after_trim(spark):
    from souq.functions.coerce import php_blank
    cases = {None: True, "": True, "  \t\n": True, " 0 ": True, "0": True, "00": False, " a ": False,
             "0a": False, "\x00": True, "x" * 10000 + " ": False}
    for value, want in cases.items():
        assert one(spark, php_blank, value) is want, repr(value)[:20]
        if value is not None:
            assert one(spark, lambda c: php_empty(html_escape(c)), value) is want


def test_line_separators_do_not_end_a_value(spark):
    from souq.functions.coerce import php_blank, to_int_prefix
    df = spark.createDataFrame([("123 ",), ("0\u0085",), ("a@b.com\u0085",), ("123\n",), ("99999999999999999999",),
                                ("-99999999999999999999",)], "v string")
    got = [tuple(r) for r in df.select(is_digits("v"), is_valid_email("v"), php_blank("v"), to_int_prefix("v")).collect()]
    assert got == [(False, False, False, 123), (False, False, False, 0), (False, False, False, 0),
                   (True, False, False, 123), (True, False, False, 2**63 - 1), (False, False, False, -2**63)]


def test_location_branch(spark):
    df = spark.createDataFrame([("A", "B", "C"), (None, "B", "C"), (None, None, None)], "c string, s string, l string")
    assert [r[0] for r in df.select(location_label("c", "s", "l")).collect()] == ["A, B", "C", "Location not specified"]
