from decimal import Decimal as D

from souq.operators import intake

PC_SCHEMA = ("arrival_no long, business_id long, name string, description string, category string, "
             "price string, discount string, image_name string, image_type string, image_size long")

UC_SCHEMA = ("arrival_no long, first_name string, last_name string, email string, phone string, "
             "password string, confirm_password string, registration_type string")


def test_product_rules_report_every_failure(spark):
    rows = [
        (1, 7, "Lamp", "Nice <b>lamp</b>", "3", "12.5", "12.5", "lamp shot.png", "image/png", 1000),
        (2, 7, "  ", "0", "abc", "0", "150", None, None, None),
        (3, 7, "Rug", "Red rug", "2x", "5usd", None, "rug.gif", "image/gif", 6000000),
        (4, 7, "Mat", "Mat", "-1", "-3", "-1", "mat.jpg", "image/jpg", 10),
    ]
    v = {r.arrival_no: r for r in intake.validate_products(spark.createDataFrame(rows, PC_SCHEMA)).collect()}
    assert v[1].errors == [] and v[1].description == "Nice &lt;b&gt;lamp&lt;/b&gt;"
    assert v[2].errors == ["name_required", "description_required", "category_invalid", "price_invalid",
                           "discount_out_of_range", "image_required"]
    assert v[3].errors == ["image_type_invalid", "image_too_large"]
    assert v[3].category_id == 2 and v[3].price_value == 5.0 and v[3].discount_value == 0.0
    assert v[4].errors == ["category_invalid", "price_invalid", "discount_out_of_range"]


def test_accepted_products_truncate_discount_and_keys(spark):
    rows = [(5, 7, "Lamp", "desc", "3", "12.5", "12.5", "lamp shot.png", "image/png", 1000)]
    val = intake.validate_products(spark.createDataFrame(rows, PC_SCHEMA))
    existing = spark.createDataFrame([(40,), (41,)], "product_id long")
    new = intake.accepted_products(val, existing).first()
    assert new.discount_percent == D("12.00")            # bound as an integer (T-09)
    assert new.price == D("12.50") and new.product_id == 46
    assert new.image_path.startswith("uploads/products/") and new.image_path.endswith("_lamp_shot.png")
    keep = intake.accepted_products(val, existing, truncate_discount=False).first()
    assert keep.discount_percent == D("12.50")


def test_user_rules_first_failure_and_email_identity(spark):
    users = spark.createDataFrame([(1, "José@Example.com")], "user_id long, email string")
    good = "password1"
    rows = [
        (1, "Ann", "Lee", "ann@x.com", "123", good, good, "customer"),
        (2, "Bob", "Ray", "ANN@x.com ", "123", good, good, "business"),     # same email as 1: later loses
        (3, "Cy", "Oz", "jose@example.COM", "123", good, good, "customer"),  # accent/case: taken
        (4, "Di", "Ng", "not-an-email", "12a", "short", "x", "customer"),    # first failure only
        (5, "Ed", "0", "ed@x.com", "1", good, good, "customer"),             # "0" is empty
        (6, "Fy", "Po", "fy@x.com", "12-3", good, good, "customer"),
        (7, "Gu", "Qi", "gu@x.com", "9", "shortpw", "shortpw", "customer"),
        (8, "Ha", "Ro", "ha@x.com", "9", good, good + "!", "customer"),
        (0, "Zed", "Early", "Ann@X.com", "1", "x", "y", "customer"),           # fails a rule: does not block
    ]
    out = {r.arrival_no: r for r in intake.validate_users(spark.createDataFrame(rows, UC_SCHEMA), users).collect()}
    assert out[1].error is None and out[1].role == "customer"
    assert out[1].username.startswith("ann.lee") and len(out[1].username) == len("ann.lee") + 3
    assert out[2].error == "email_in_use"
    assert out[3].error == "email_in_use"
    assert out[4].error == "email_invalid"
    assert out[5].error == "fields_required"
    assert out[6].error == "phone_invalid"
    assert out[7].error == "password_too_short"
    assert out[8].error == "password_mismatch"
    assert out[0].error == "password_too_short"
    assert "password" not in intake.validate_users(spark.createDataFrame(rows, UC_SCHEMA), users).columns


def test_slug_report_and_roles(spark):
    df = spark.createDataFrame([(1, "Red Mug"), (2, "red-mug"), (3, "!!!"), (4, "Blue")], "product_id long, name string")
    rep = {r.slug: (r.rows, r.is_empty) for r in intake.slug_report(df, "name", "product_id").collect()}
    assert rep == {"red-mug": (2, False), "": (1, True)}
    u = spark.createDataFrame([("admin",), ("customer",), ("customer",)], "role string")
    assert {r.role: r.users for r in intake.role_counts(u).collect()} == {"admin": 1, "customer": 2}
    assert intake.has_role(u, "business_owner").count() == 0


def test_accepted_product_slug_uses_the_submitted_name(spark):
    rows = [(1, 7, "  Tom & Jerry's Mug ", "d", "3", "5", None, "m.png", "image/png", 10)]
    val = intake.validate_products(spark.createDataFrame(rows, PC_SCHEMA))
    new = intake.accepted_products(val, spark.createDataFrame([], "product_id long")).first()
    assert new.slug == "tom-jerry-s-mug" and new.name == "Tom &amp; Jerry&#039;s Mug"
    assert dict(intake.accepted_products(val, spark.createDataFrame([], "product_id long")).dtypes)["created_at"] == "timestamp_ntz"


def test_too_large_a_price_is_one_reject(spark):
    from souq.operators import intake
    from souq.streaming.intake_stream import PRODUCT_CANDIDATE_SCHEMA
    rows = [(1, 5, "Lamp", "desc", "3", "100000000", None, "a.png", "image/png", 10),
            (2, 5, "Lamp", "desc", "3", "10", None, "a.png", "image/png", 10)]
    v = intake.validate_products(spark.createDataFrame(rows, PRODUCT_CANDIDATE_SCHEMA))
    none = spark.createDataFrame([], "product_id bigint")
    assert [r["arrival_no"] for r in intake.accepted_products(v, none).collect()] == [2]
    assert [tuple(r) for r in intake.unstorable_products(v).collect()] == [(1, "value_out_of_range")]
