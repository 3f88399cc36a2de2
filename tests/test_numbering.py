"""Ranks, running totals, free numbers, unique usernames and slugs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from souq.operators import integrity, intake
from souq.operators.numbering import free_numbers, ranked, running_total


@pytest.mark.parametrize("block", [1, 4, 1 << 16])
def test_ranked_and_running_total(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice("aab"), i * rng.choice([1, 7]) + 100 * (i % 9), rng.randrange(5)) for i in range(200)]
    rows = list({(k, o): (k, o, x) for k, o, x in rows}.values())
    df = spark.createDataFrame(rows, "k string, o bigint, x int")
    got = sorted(map(tuple, ranked(df, ["k"], "o", "r", block).select("k", "o", "r").collect()))
    by = defaultdict(list)
    for k, o, x in sorted(rows):
        by[k].append((o, x))
    assert got == sorted((k, o, i + 1) for k, v in by.items() for i, (o, _) in enumerate(v))
    got = sorted(map(tuple, running_total(df, ["k"], "o", "x", "x", "t", block).select("k", "o", "t").collect()))
    assert got == sorted((k, o, sum(x for _, x in v[:i + 1])) for k, v in by.items() for i, (o, _) in enumerate(v))


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_free_numbers(spark, block):
    rng = random.Random(3)
    used = [(k, rng.randrange(90, 160)) for k in "abc" for _ in range(40)] + [("d", 100), ("z", 100)]
    wanted = [(rng.choice("abcde"), i * 3) for i in range(150)]
    got = free_numbers(spark.createDataFrame(wanted, "k string, arrival_no bigint"),
                       spark.createDataFrame(used, "k string, number int"), ["k"], 100, block=block)
    want, have = [], defaultdict(set)
    for k, n in used:
        have[k].add(n)
    for k, a in sorted(wanted, key=lambda x: x[1]):
        n = next(i for i in range(100, 1000) if i not in have[k])
        have[k].add(n)
        want.append((k, a, n))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_free_numbers_of_one_key_are_spread(spark):
    """One key is numbered by as many tasks as it has blocks: no window is over the key alone but those of sums."""
    wanted = spark.range(0, 1000).select(F.lit("hot").alias("k"), F.col("id").alias("arrival_no"))
    used = spark.createDataFrame([("hot", 100)], "k string, number int")
    plan = free_numbers(wanted, used, ["k"], 100, block=50)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if " Window [row_number" in x or "+- Window [row_number" in x]
    assert windows and all("_block" in x for x in windows)


def _users(spark, rows):
    return spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "user_id bigint, username string")


def test_equal_names_get_distinct_usernames(spark):
    batch = spark.createDataFrame([(i, ["Ann", "ANN", "Ánn"][i % 3], "Lee") for i in range(1200)],
                                  "arrival_no bigint, first_name string, last_name string")
    table = _users(spark, [f"ann.lee{n}" for n in range(150, 700)] + ["ann.lee0150", "ann.lee99", "Ann.Lee100 ", "ann.lee"])
    got = intake.allocate_usernames(batch, table).orderBy("arrival_no").collect()
    assert len(got) == 1200
    numbers = [int(r.username[-4:] if r.username[-4].isdigit() else r.username[-3:]) for r in got]
    assert numbers == [n for n in range(101, 2000) if not 150 <= n < 700][:1200]
    both = table.unionByName(spark.createDataFrame([(10_000 + r.arrival_no, r.username) for r in got],
                                                   "user_id bigint, username string"))
    audit = {r.key_name: r.duplicate_keys for r in integrity.key_audit({"users": both.withColumn("email", F.col("username"))})
             .collect()}
    assert audit["username"] == 0


def test_names_that_end_in_digits_do_not_collide(spark):
    batch = spark.createDataFrame([(i, "A", ["B", "B2", "B21", "B2."][i % 4]) for i in range(4000)],
                                  "arrival_no bigint, first_name string, last_name string")
    names = [r.username for r in intake.allocate_usernames(batch, _users(spark, ["a.b2.100", "a.b1000"])).collect()]
    assert len(set(names)) == 4000 and not {"a.b2.100", "a.b1000"} & set(names)
    assert max(map(len, names)) <= 50


def test_long_names_fit_the_column(spark):
    batch = spark.createDataFrame([(1, "x" * 50, "y" * 50), (2, "x" * 50, "z")],
                                  "arrival_no bigint, first_name string, last_name string")
    names = [r.username for r in intake.allocate_usernames(batch, _users(spark, [])).collect()]
    assert len(set(names)) == 2 and max(map(len, names)) <= 50


def test_accepted_users_are_unique_in_table_and_batch(spark):
    rows = [(i, "Ann", "Lee", f"a{i}@x.org", "555", "longenough", "longenough", "customer") for i in range(1000)]
    cand = spark.createDataFrame(rows, "arrival_no bigint, first_name string, last_name string, email string, "
                                       "phone string, password string, confirm_password string, registration_type string")
    table = spark.createDataFrame([(1, "ann.lee100", "z@x.org")], "user_id bigint, username string, email string")
    out = intake.accepted_users(intake.validate_users(cand, table), table)
    names = [r.username for r in out.collect()]
    assert len(names) == 1000 == len(set(names)) and "ann.lee100" not in names


def test_slugs(spark):
    rows = [(5, "Red Chair"), (6, "red chair!"), (7, "red-chair"), (8, "Red chair 2"), (9, "red-chair-2"), (10, "!!!"),
            (11, None), (12, "blue"), (13, "blue")]
    df = spark.createDataFrame(rows, "arrival_no bigint, name string")
    table = spark.createDataFrame([("red-chair",), ("red-chair-3",), ("product",), (None,), ("Blue-2",)], "slug string")
    got = {r.arrival_no: r.slug for r in intake.assign_slugs(df, table, "name").collect()}
    assert got == {5: "red-chair-4", 6: "red-chair-5", 7: "red-chair-6", 8: "red-chair-2", 9: "red-chair-2-2",
                   10: "product-2", 11: "product-3", 12: "blue", 13: "blue-3"}


def test_random_slugs_are_unique(spark):
    rng = random.Random(8)
    pool = ["a", "a-2", "a-2-2", "a-3", "A 2", "b", "?", "a-02", "x" * 300]
    df = spark.createDataFrame([(i, rng.choice(pool)) for i in range(500)], "id bigint, name string")
    table = [(rng.choice(pool[:-1]) + rng.choice(["", "-2", "-5"]),) for _ in range(10)]
    got = intake.assign_slugs(df, spark.createDataFrame(table, "slug string"), "name", arrival="id").collect()
    slugs = [r.slug for r in got]
    assert len(got) == 500 == len(set(slugs)) and not {t.lower() for t, in table} & set(slugs)
    assert all(s for s in slugs) and sum(len(s) > 255 for s in slugs) == 1   # the one that keeps its own slug
