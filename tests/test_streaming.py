import os
import tempfile

import pytest
from pyspark.sql import functions as F

from souq.streaming import intake_stream as st


def test_user_intake_stream_across_batches(spark):
    root = tempfile.mkdtemp(prefix="souq-stream-")
    inbox, users, rejects = (os.path.join(root, x) for x in ("inbox", "users", "rejects"))
    os.makedirs(inbox)
    good = "password1"
    b1 = [(1, "Ann", "Lee", "ann@x.com", "123", good, good, "customer"),
          (2, "Bob", "Ray", "bad", "123", good, good, "business")]
    b2 = [(3, "Ann", "Two", "ANN@x.com", "123", good, good, "customer"),   # taken by batch 1
          (4, "Ann", "Lee", "cy@x.com", "123", good, good, "business")]
    spark.createDataFrame(b1, st.USER_CANDIDATE_SCHEMA).coalesce(1).write.parquet(os.path.join(inbox, "a"))
    spark.createDataFrame(b2, st.USER_CANDIDATE_SCHEMA).coalesce(1).write.parquet(os.path.join(inbox, "b"))
    # one file per micro-batch, so the second batch sees the first one's users
    q = st.start_user_intake(spark, os.path.join(inbox, "*"), users, rejects, available_now=True,
                             files_per_batch=1, checkpoint=os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(users)
    assert sorted(r.arrival_no for r in got.collect()) == [1, 4]
    assert {r.arrival_no: r.role for r in got.collect()}[4] == "business_owner"
    rej = {r.arrival_no: r.error for r in spark.read.parquet(rejects).collect()}
    assert rej == {2: "email_invalid", 3: "email_in_use"}
    assert got.select(F.countDistinct("user_id")).first()[0] == 2
    assert {r.arrival_no: r.username for r in got.collect()} == {1: "ann.lee100", 4: "ann.lee101"}


def test_product_intake_stream(spark):
    root = tempfile.mkdtemp(prefix="souq-stream-")
    inbox, products, rejects = (os.path.join(root, x) for x in ("inbox", "products", "rejects"))
    rows = [(1, 5, "Lamp", "desc", "3", "10", None, "a.png", "image/png", 10),
            (2, 5, "", "desc", "3", "10", None, "a.png", "image/png", 10)]
    spark.createDataFrame(rows, st.PRODUCT_CANDIDATE_SCHEMA).write.parquet(inbox)
    q = st.start_product_intake(spark, inbox, products, rejects, available_now=True,
                                checkpoint=os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    assert [r.arrival_no for r in spark.read.parquet(products).collect()] == [1]
    assert [(r.arrival_no, r.error_codes) for r in spark.read.parquet(rejects).collect()] == [(2, "name_required")]


def test_a_replayed_batch_keeps_its_rows(spark):
    root = tempfile.mkdtemp(prefix="souq-stream-")
    inbox, users, rejects, ckpt = (os.path.join(root, x) for x in ("inbox", "users", "rejects", "ckpt"))
    good = "password1"
    for name, row in (("a", (1, "Ann", "Lee", "ann@x.com", "123", good, good, "customer")),
                      ("b", (2, "Cy", "Oz", "cy@x.com", "123", good, good, "business"))):
        spark.createDataFrame([row], st.USER_CANDIDATE_SCHEMA).coalesce(1).write.parquet(os.path.join(inbox, name))
    start = lambda: st.start_user_intake(spark, os.path.join(inbox, "*"), users, rejects, available_now=True,
                                         files_per_batch=1, checkpoint=ckpt).awaitTermination(120)
    start()
    for f in os.listdir(os.path.join(ckpt, "commits")):        # what a crash after the write leaves
        if f.lstrip(".").startswith("1"):
            os.remove(os.path.join(ckpt, "commits", f))
    start()
    assert sorted(r.arrival_no for r in spark.read.parquet(users).collect()) == [1, 2]


def test_an_unreadable_table_is_an_error(spark, tmp_path):
    assert st.read_table(spark, str(tmp_path / "absent"), "a int").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        st.read_table(spark, str(tmp_path / "bad"), "a int").count()
