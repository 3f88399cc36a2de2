"""Random strings: Spark expressions against direct Python statements of the rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from souq.functions import html_escape, slugify, to_int_prefix, truncate_text

TRIM = " \t\n\r\x00\x0b"


def py_truncate(s, n=100):
    b = s.encode()
    if len(b) <= n:
        return s
    cut = b[:n]
    pos = cut.rfind(b" ")
    return ("" if pos < 0 else cut[:pos].decode()) + "..."


def py_slug(s):
    return re.sub(r"[^a-zA-Z0-9-]+", "-", s).strip("-").lower()


def py_escape(s):
    s = s.strip(TRIM)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        s = s.replace(a, b)
    return s


def py_intval(s):
    m = re.match(r"[ \t\n\r\x0b\f]*([+-]?[0-9]+)", s)
    return int(m.group(1)) if m else 0


text = st.text(alphabet=st.sampled_from(list("ab é漢 -_&<>'\"0123\t\n") + ["😀", "ß", "Ä"]), max_size=160)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(text, min_size=1, max_size=40))
def test_text_rules_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = df.select("i", truncate_text("v").alias("t"), slugify("v").alias("s"),
                    html_escape("v").alias("h")).collect()
    for r in got:
        v = values[r.i]
        assert r.t == py_truncate(v), v
        assert r.s == py_slug(v), v
        assert r.h == py_escape(v), v


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.from_regex(r"[ \t]{0,2}[+-]?[0-9]{0,6}[a-z.]{0,3}", fullmatch=True), min_size=1, max_size=40))
def test_intval_matches_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for r in df.select("i", to_int_prefix(F.col("v")).alias("n")).collect():
        assert r.n == py_intval(values[r.i]), values[r.i]
