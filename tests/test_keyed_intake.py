"""User intake with keyed state against the batch validator."""

import os
import random

import pytest

from souq.operators import intake
from souq.streaming import intake_stream, keyed_intake

GOOD = "password1"


def _write(spark, rows, path):
    spark.createDataFrame(rows, intake_stream.USER_CANDIDATE_SCHEMA).coalesce(1).write.parquet(path)


def _run(spark, root):
    q = keyed_intake.start_keyed_user_intake(spark, f"{root}/inbox/*", f"{root}/users", f"{root}/out", available_now=True,
                                             files_per_batch=1, checkpoint=f"{root}/ckpt")
    q.awaitTermination(300)
    assert q.exception() is None


@pytest.fixture
def root(spark, tmp_path):
    users = [(1, "old@x.org", "ann.lee100"), (2, "ÜNI@x.org ", "u2"), (3, None, "u3")]
    spark.createDataFrame(users, "user_id bigint, email string, username string").write.parquet(str(tmp_path / "users"))
    return str(tmp_path)


def test_same_acceptance_as_one_batch_over_restarts(spark, root):
    rng = random.Random(5)
    emails = ["old@X.org", "uni@x.org", "hot@x.org", "bad", *(f"e{i}@x.org" for i in range(12))]
    rows = []
    for i in range(90):
        e = "HOT@x.org" if i % 3 == 0 else rng.choice(emails)
        rows.append((i, "Ann", "Lee", rng.choice([e, e.upper(), e + " "]), "123", GOOD, rng.choice([GOOD, GOOD, "other"]), "customer"))
    for b in range(2):
        _write(spark, rows[b * 30:b * 30 + 30], f"{root}/inbox/{b}")
    _run(spark, root)
    _write(spark, rows[60:], f"{root}/inbox/2")
    _run(spark, root)                                      # a restart: the state is still there
    users = spark.read.parquet(f"{root}/users")
    batch = intake.validate_users(spark.createDataFrame(rows, intake_stream.USER_CANDIDATE_SCHEMA), users)
    want = {(r.arrival_no, r.email, r.error) for r in batch.collect()}
    got = {(r.arrival_no, r.email, r.error) for r in spark.read.parquet(f"{root}/out/decisions").collect()}
    assert got == want
    accepted = spark.read.parquet(f"{root}/out/accepted").collect()
    assert sorted(r.arrival_no for r in accepted) == sorted(a for a, _, e in want if e is None)
    names = [r.username for r in accepted]
    assert len(set(names)) == len(names) > 3 and "ann.lee100" not in names


def test_a_replayed_batch_decides_the_same(spark, root):
    for b, (i, e) in enumerate([(1, "a@x.org"), (2, "A@x.org"), (3, "b@x.org")]):
        _write(spark, [(i, "Cy", "Oz", e, "123", GOOD, GOOD, "business")], f"{root}/inbox/{b}")
    _run(spark, root)
    commits = sorted(f for f in os.listdir(f"{root}/ckpt/commits") if f.isdigit())
    for f in os.listdir(f"{root}/ckpt/commits"):           # what a crash after the write leaves
        if f.lstrip(".").startswith(commits[-1]):
            os.remove(f"{root}/ckpt/commits/{f}")
    _run(spark, root)
    got = {r.arrival_no: r.error for r in spark.read.parquet(f"{root}/out/decisions").collect()}
    assert got == {1: None, 2: "email_in_use", 3: None}
    assert sorted(r.arrival_no for r in spark.read.parquet(f"{root}/out/accepted").collect()) == [1, 3]
