"""Operators against direct Python statements of their definitions, on the smallest driver tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from souq.llm import html_wrappers, license_scan, line_dedup, queries, suffix_dedup
from souq.llm.decontamination import words_of
from souq.llm.suffix_groups import common_prefixes, suffix_array

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in queries.table(spark, SF, "documents").collect()}


def words(text):
    return (text or "").encode().lower().split()


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(2000):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 20))] + [0]
        order = suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = common_prefixes(s, order)
        for r in range(1, len(s)):
            a, b = s[order[r - 1]:], s[order[r]:]
            assert lcp[r] == next(k for k in range(len(s)) if k >= min(len(a), len(b)) or a[k] != b[k])


def test_decontamination(spark, docs):
    items = {r["item_id"]: r["text"] for r in queries.table(spark, SF, "benchmark").collect()}
    want = {(d, i) for d, r in docs.items() for i, t in items.items()
            if f" {' '.join(words_of(t))} " in f" {' '.join(words_of(r['text']))} "}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontamination(spark, SF).collect()}
    assert want and want <= got
    for d, i in got - want:                       # the rest overlaps by most of the item's word triples
        w = words_of(items[i])
        have = words_of(docs[d]["text"])
        grams = {tuple(have[k:k + 3]) for k in range(len(have))}
        own = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        assert sum(g in grams for g in own) >= 0.7 * len(own)


def test_jaccard(spark, docs):
    sets = {}
    for d, r in docs.items():
        w = words(r["text"])
        sets[d] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {d: d for d in docs}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in docs:
        for b in docs:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4_jaccard_join(spark, SF).collect()}
    assert got == {d: (len(sets[d]), root(d)) for d in docs}


def test_repeats(spark, docs):
    size = 400
    texts = {d: (r["text"] or "").encode() for d, r in docs.items()}
    seen = collections.Counter(b[i:i + size] for b in texts.values() for i in range(len(b) - size + 1))
    for r in queries.op5_suffix_dedup(spark, SF).collect():
        b = texts[r["doc_id"]]
        covered, end = bytearray(len(b)), 0
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                covered[max(i, end):i + size] = b"\1" * (i + size - max(i, end))
                end = i + size
        kept = bytes(c for c, f in zip(b, covered) if not f)
        runs = sum(1 for i, f in enumerate(covered) if f and not (i and covered[i - 1]))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())


def test_language_model(spark, docs):
    tokens = {d: [*words(r["text"]), b"\n"] for d, r in docs.items()}
    out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    c = collections.Counter(w for d, t in tokens.items() if not out[d] for w in t)
    n, v = sum(c.values()), len(c)
    base = model = size = 0
    for r in queries.op8_class_lm(spark, SF).collect():
        t = tokens[r["doc_id"]]
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            out[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(want) and r["score"] < 0
        if r["held_out"]:
            base, model, size = base + r["base_score"], model + r["score"], size + len(t)
    assert model / size > base / size + 0.05       # held-out perplexity below the base's


def test_token_totals(spark, docs):
    import base64

    import tiktoken
    from souq.llm.token_rollup import PATTERN
    with open(queries.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    encode = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    toxic = {r["doc_id"] for r in queries.table(spark, SF, "labels").where("toxic = 1").collect()}
    want = collections.Counter()
    for d, r in docs.items():
        if d not in toxic:
            want[(r["source"], r["lang"], "byte_bpe_50k")] += len(encode(r["text"] or ""))
            want[(r["source"], r["lang"], "words")] += len((r["text"] or "").encode().split())
    got = {(r["source"], r["lang"], r["version"]): r["tokens"] for r in queries.op6_token_rollup(spark, SF).collect()}
    assert got == dict(want)


def test_pages(spark):
    import html
    import re
    pages = {r["page_id"]: r["html"] for r in queries.table(spark, SF, "pages").collect()}
    for r in queries.op3_html_wrappers(spark, SF).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", article.replace("<br>", " ")))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_licenses(spark, docs):
    notices = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
               "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "reserved",
               "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = {(d, i, notices[x]) for d, r in docs.items() for i, x in enumerate((r["text"] or "").split("\n"))
            if x in notices}
    got = {(r["doc_id"], r["line"], r["license"]) for r in queries.op10_license_scan(spark, SF).collect() if r["exact"]}
    assert want <= got


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = sorted((dict(zip(cols, r)) for r in cur.fetchall()), key=lambda r: r["doc_id"])
    got = sorted((r.asDict() for r in queries.QUERIES[name](spark, SF).collect()), key=lambda r: r["doc_id"])
    assert got == want


def brute_line_runs(texts):
    """Lines to remove by key: those in a run of lines (two or more with words, or one of over 50) seen at an earlier place."""
    first, occurrences = {}, []
    for k in sorted(texts):
        lines = texts[k].split("\n")
        solid = [i for i, x in enumerate(lines) if x.split()]
        for a, i in enumerate(solid):
            for j in solid[a:]:
                if i < j or len(lines[i].split()) > 50:
                    run = tuple(lines[i:j + 1])
                    occurrences.append((k, i, j, run))
                    first.setdefault(run, (k, i))
    gone = {k: set() for k in texts}
    for k, i, j, run in occurrences:
        if first[run] != (k, i):
            gone[k].update(range(i, j + 1))
    kept = {}
    for k, t in texts.items():
        lines = t.split("\n")
        solid = [i for i, x in enumerate(lines) if x.split()]
        owner = [max((s for s in solid if s <= i), default=min(solid, default=None)) for i in range(len(lines))]
        kept[k] = "\n".join(x for x, o in zip(lines, owner) if o not in gone[k])
    return kept


def test_line_runs(spark):
    rng = random.Random(7)
    line = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.choice([1, 2, 5, 51])))
    pool = [line() for _ in range(30)] + ["", " "]
    texts = {i: "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"{line()} {i}" for _ in range(rng.randint(1, 14)))
             for i in range(120)}
    for i in range(0, 120, 3):                       # passages of one to six lines put into other texts
        lines = texts[i].split("\n")
        at = rng.randrange(len(lines))
        texts[(i * 7 + 5) % 120] += "\n" + "\n".join(lines[at:at + rng.randint(1, 6)]) + rng.choice(["", "\n", "\nend"])
    long = " ".join(f"w{i}" for i in range(51))
    texts |= {200: long, 201: f"before\n{long}\nafter", 202: "x y\nz w", 203: "p\n\nx y\nz w\n\nq", 204: "x y\n\nz w\n"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df, n_chars=None).collect()}
    assert got == brute_line_runs(texts)
    assert got[201] == "before\nafter" and got[203] == "p\n\nq" and got[204] == texts[204]


def test_notices_in_long_lines(spark, docs):
    rng = random.Random(3)
    prose = " ".join(r["text"] for _, r in sorted(docs.items()) if r["lang"] == "en" and not re.search(
        license_scan.CANDIDATE, r["text"])).split()
    rows, want = [], set()
    for i, (name, notice) in enumerate(sorted(license_scan.TEMPLATES.items()) * 8):
        at = rng.randrange(len(prose) - 9_000)
        length, cut = (150, 800, 3_000, 9_000)[i % 4], rng.randrange(150)
        rows.append((i, " ".join(prose[at:at + cut] + [notice] + prose[at + cut:at + length])))
        want.add((i, name, True))
    many = " ".join(license_scan.TEMPLATES.values())
    rows.append((1000, f"{many} {' '.join(prose[:500])} {many}"))
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["key"], r["license"], r["exact"]) for r in got if r["key"] < 1000} == want
    assert collections.Counter(r["license"] for r in got if r["key"] == 1000 and r["exact"]) == \
        dict.fromkeys(license_scan.TEMPLATES, 2)


def test_wrapped_and_changed_notices(spark):
    rows, want = [], set()
    for name, notice in sorted(license_scan.TEMPLATES.items()):
        words = notice.split()
        for cut in range(1, len(words)):
            for mark in ("\n", "\n# ", "\n * "):
                rows.append((len(rows), f"first line\nbefore{mark}{' '.join(words[:cut])}{mark}{' '.join(words[cut:])}\nafter"))
                want.add((len(rows) - 1, 2, name, 0, True))
    for text, name, missing in [
            (license_scan.TEMPLATES["BSD-3-Clause"].replace("source and ", "", 1).replace("provided", "given"),
             "BSD-3-Clause", 3),
            ("Distributed under the MIT License.", "MIT", 1), ("Released under CC BY 4.0.", "CC-BY-4.0", 1),
            ("Work licensed under the GNU General Public\nLicense, version 2", "GPL-2.0", 2)]:
        rows.append((len(rows), text))
        want.add((len(rows) - 1, 0, name, missing, False))
    rows += [(-1, "Licensed under the Apache License, Version 3.0."), (-2, "Released under the BSD License."),
             (-3, "All rights\n\nwere reversed.")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["key"], r["line"], r["license"], r["n_missing"], r["exact"]) for r in got} == want
    assert all(len(r["missing"].split()) == r["n_missing"] for r in got)


def texts_of_pages(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in html_wrappers.extract(df).collect()}


def test_hosts_with_several_templates(spark):
    page = "<html><body><nav><a href=/>home</a></nav>%s<footer>end</footer></body></html>"
    kinds = ["<article><p>T%d</p></article>", "<main><p>T%d</p></main>", "<div class=content><p>T%d</p></div>",
             "<div class=x><p>T%d</p></div>", "<section class=y><p>T%d</p></section>",
             "<article class='post no-sidebar'><p>T%d</p></article>", "<article class='has-comments'><p>T%d</p></article>",
             "<main><article><p>T%d</p></article></main>", "<main><div><p>T%d</p></div></main>"]
    pages = [(u, page % (kinds[i % len(kinds)] % i)) for u in ("http://a.example/", None) for i in range(4 * len(kinds))]
    want = [f"T{i}" for _ in range(2) for i in range(4 * len(kinds))]
    got = texts_of_pages(spark, pages)
    assert [got[i] for i in range(len(pages))] == want


def test_fixed_texts_are_whole_texts_of_differing_pages(spark):
    head = "the same opening words " * 5                      # over 80 characters
    page = "<html><body><div class=x>%s</div><div class=y><p>%s</p></div></body></html>"
    menu = "the fixed words of this site " * 40
    pages = [("http://a.example/", page % (menu, head + f"end {i}")) for i in range(5)]
    pages += [("http://b.example/", page % ("short", "one page in copies"))] * 4
    got = texts_of_pages(spark, pages)
    assert [got[i] for i in range(5)] == [head + f"end {i}" for i in range(5)]
    assert all("one page in copies" in got[i] for i in range(5, 9)) and len({got[i] for i in range(5, 9)}) == 1


def test_matches_that_end_on_a_first_letter():
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200))
    for _ in range(300):
        shared = text()[:398].rstrip()
        shared = (shared + "x" * 399)[:398] + " " + rng.choice("abcdefgh")
        assert len(shared) == suffix_dedup.LENGTH
        one, other = rng.sample("abcdefgh", 2)
        pair = [(shared + c + text()[:250]).encode() for c in (one, other)]
        assert suffix_dedup.worth_comparing(pair) == [True, True]
