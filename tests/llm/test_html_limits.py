"""Deep nesting, long sibling lists, names of furniture."""

import functools
import json
import random
import time

import pytest

from souq.llm import html_wrappers as hw


def token(sig):
    return [sig, "p", "", False, False, 1, 0, None, []]


def test_common_subsequence_is_the_longest():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([token(rng.choice("abcdef")) for _ in range(rng.randrange(0, 12))] for _ in range(2))

        @functools.cache
        def longest(i, j):
            if i == len(a) or j == len(b):
                return 0
            return longest(i + 1, j + 1) + 1 if a[i][0] == b[j][0] else max(longest(i + 1, j), longest(i, j + 1))
        pairs = hw._common(a, b)
        assert len(pairs) == longest(0, 0)
        assert pairs == sorted(set(pairs)) and all(a[i][0] == b[j][0] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_long_sibling_lists_keep_every_token():
    start = time.time()
    a = [token(f"x{i * 7 % 50_021}") for i in range(50_000)]
    b = [token(f"x{i * 7 % 50_021}") for i in range(0, 50_000, 2)]
    out = hw.align(a, b)
    assert len(out) == 50_000 and sum(not x[hw.OPT] for x in out) == 25_000
    rng = random.Random(3)
    a, b = ([token(rng.choice("abcdefgh")) for _ in range(20_000)] for _ in range(2))   # nothing unique
    chars = lambda nodes: sum(x[hw.CHARS] + chars(x[hw.KIDS]) for x in nodes)
    assert chars(hw.align(a, b)) == 40_000
    assert time.time() - start < 60


def test_deep_nesting(spark):
    deep = "<div>" * 100_000 + "deep text" + "</div>" * 100_000 + "<p>after</p>"
    nav = "<div>" * 500 + "<nav><a href=x>menu</a></nav>inner" + "</div>" * 500
    open_only = "<article>" + "<section>" * 3_000 + "never closed"
    rows = [(1, "http://a.org/1", deep), (2, "http://a.org/2", f"<article><p>One.</p>{nav}</article>"),
            (3, "http://a.org/3", open_only), (4, "http://b.org/4", f"<article>{deep}</article>")]
    got = {r.page_id: r.text for r in hw.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert "deep text" in got[4] and "after" in got[4]
    assert got[2] == "One.\ninner" and got[3] == "never closed"
    json.dumps(hw.shape(hw.parse(deep)))


@pytest.mark.parametrize("name", ["share-price-analysis", "legal-history", "notice-of-motion", "headerless", "Kommentar"])
def test_names_of_articles_are_not_furniture(name):
    assert hw._classify("div", f' class="{name}"')[1] != "-"


@pytest.mark.parametrize("name", ["site-footer", "mainNav", "cookie_banner", "comment-list", "related-posts", "sidebar2",
                                  "wp-sidebar", "share-buttons", "ad", "ad-slot top", "newsletterSignup", "page-header"])
def test_names_of_furniture(name):
    assert hw._classify("div", f' class="{name}"')[1] == "-"


def test_article_text_below_such_names_is_kept():
    page = ('<article><p>Lead.</p><div class="share-price-analysis"><p>Prices rose.</p></div>'
            '<p class="notice-of-motion">Moved.</p><div class="share-buttons">Tweet</div></article>')
    assert hw.main_text(page, [["/article"]]) == "Lead.\nPrices rose.\nMoved."
