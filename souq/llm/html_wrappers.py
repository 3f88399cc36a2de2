"""Main text of web pages by wrappers: union-free regular expressions of each host's pages.

A page is a stream of tags and texts.  Streams of one host are aligned one
after another: where both agree the token stays; texts that differ become a
text slot; tokens that only one stream has become optional; and adjacent
repetitions, single or of several tokens, fold into one repeated group.  The
result has no alternatives (it is union-free) and aligning two results gives
another, so alignment is a tree of merges: equal page shapes of a host are
counted together before any shuffle, then merged in groups of at most
``FAN_IN`` until every host has one wrapper.  All pages take part.

The wrapper says which of its parts may be the article: the outermost parts
that are marked as such (articles first, then <main>, then other marks), then
unmarked parts by their text outside links and fixed texts, richest first.
Every page takes the first of them in which it has text, as a host may have
several templates, and a page with none all text outside links and furniture.  Parts that are furniture by element, role or name
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) are left out, at any depth.  A page is then read against its
host's wrapper: text is kept where the wrapper's part on the same path is
kept.

Character references are decoded; white space inside a block becomes one
space; blocks are trimmed, empty ones dropped, and the rest joined by a line
feed in page order.  Null, empty and markup-free html give an empty text
(plain text outside any element is no article).  Pages without a host share
one.  Repeated rows are treated alike.  Other columns pass through; a
``text`` or ``n_chars`` among them is replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souq.llm.common import fresh_name, null_safe, work_folder, write_table

FAN_IN = 64
#: Nesting of elements that is kept, and cells of an alignment's table.
DEPTH = 200
CELLS = 1 << 20
MAX_PERIOD = 4                       # tokens in a repeated group
FIXED_PAGES = 3                      # a text is fixed if it is the same on so many differing pages of a shape or more

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
                   r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre "
                   "section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An element closes these when it opens inside them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol table div article section main body td th blockquote dl nav aside footer header form".split())
FURNITURE_TAGS = frozenset("nav footer aside form script style noscript template iframe svg math button select option "
                           "textarea input label fieldset menu dialog object canvas audio video head title "
                           "header".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu "
                            "menubar toolbar".split())
FURNITURE_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
                            "banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer "
                            "bottombar sidebar aside widget widgets cookie cookies consent gdpr notice notices alert "
                            "popup modal overlay newsletter subscribe subscription signup login comment comments "
                            "commentlist disqus reply replies respond share sharing social related recommended "
                            "pagination pager copyright legal skip search toolbar hidden".split())
ARTICLE_NAMES = frozenset("article content main post entry story articlebody maincontent postbody".split())
# What else stands in the names of furniture: a name is one if all its parts are in either set, one at least above.
LAYOUT_NAMES = frozenset("site page main global primary secondary top bottom left right upper lower first last inner outer box "
                         "bar list item items wrap wrapper container block section area zone slot region panel pane col column "
                         "row grid group link links button buttons btn icon icons posts post articles stories story content body "
                         "head title text form field input thread count meta info tools tool bars more read next prev previous "
                         "the and of js is has no fixed sticky mobile desktop mini large small big".split())
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


class Element:
    """An element: its signature, kind and children (elements and texts in page order)."""
    __slots__ = ("tag", "sig", "kind", "kids")

    def __init__(self, tag: str, sig: str, kind: str):
        self.tag, self.sig, self.kind, self.kids = tag, sig, kind, []


def _furniture(parts: list[str]) -> bool:
    """Whether a class or id, in parts, names furniture; short parts before a name are a maker's prefix."""
    own = [p in FURNITURE_NAMES for p in parts]
    return any(own) and all(f or p in LAYOUT_NAMES or len(p) <= 3 for f, p in zip(own, parts))


def _classify(tag: str, attributes: str) -> tuple[str, str]:
    """Signature and kind ('-' furniture, '+' marked article, '' neither) of a start tag."""
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = sorted({x.lower() for k in ("class", "id") for x in re.split(r"[\s\d]+", a.get(k, "")) if x})
    named = [[p.lower() for p in NAME_PARTS.findall(x)] for k in ("class", "id") for x in a.get(k, "").split()] if names else []
    parts = {p for x in named for p in x}
    role = a.get("role", "").lower()
    sig = ".".join([tag, *names]) + (f"@{role}" if role else "")
    style = a.get("style", "").replace(" ", "").lower() if "style" in a else ""
    # body, main and article hold furniture but are none, whatever their classes say of the page's layout
    if tag in FURNITURE_TAGS or role in FURNITURE_ROLES or "hidden" in a or a.get("aria-hidden") == "true" \
            or "display:none" in style or (tag not in ("html", "body", "main", "article") and any(map(_furniture, named))):
        return sig, "-"
    if tag in ("article", "main") or role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody" \
            or (tag in ("div", "section", "td") and parts & ARTICLE_NAMES):
        return sig, "+"
    return sig, ""


def parse(page: str) -> Element:
    """The tree of a page; unclosed and misnested elements end where their container does.

    Elements deeper than DEPTH are not nested any further: what they hold belongs to their ancestor at that depth,
    furniture apart, which holds its own.
    """
    root = Element("", "", "")
    stack, pos, n = [root], 0, len(page)
    deep: list[str] = []                                      # open elements below the stack's,
    mark = None                                               # and the place of the furniture among them
    known: dict[tuple[str, str], tuple[str, str]] = {}
    while pos < n:
        m = TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].kids.append(m[0])
            elif m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:-3])
            continue
        tag = tag.lower()
        if deep and (tag in deep if m[1] else tag in BLOCKS and deep[-1] == "p"):
            while deep.pop() != (tag if m[1] else "p"):
                pass
            if mark is not None and len(deep) <= mark:
                stack.pop()
                mark = None
            if m[1]:
                continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES and tag not in SCOPES and tag not in ("html", "body"):
                    break
            continue
        if tag in BLOCKS and not deep:
            for i in range(len(stack) - 1, 0, -1):            # a block ends an open paragraph
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
        for i in range(len(stack) - 1, 0, -1) if not deep else ():
            if stack[i].tag in CLOSES.get(tag, ()):
                del stack[i:]
            elif stack[i].tag in SCOPES:
                break
        key = (tag, m[3])
        if key not in known:
            known[key] = _classify(tag, m[3])
        e = Element(tag, *known[key])
        stack[-1].kids.append(e)
        if tag in RAW:
            end = RAW[tag].search(page, pos)
            pos = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            if not deep and len(stack) < DEPTH:
                stack.append(e)
                continue
            if e.kind == "-" and mark is None:
                stack.append(e)
                mark = len(deep)
            deep.append(tag)
    return root


# A wrapper node is [sig, tag, kind, optional, repeated, chars, linked chars, text, kids]; a text slot has the
# sig "#", a repeated group of several nodes "()".  text is the fixed text so far, None once texts differ.
SIG, TAG, KIND, OPT, REP, CHARS, LINKED, TEXT, KIDS = range(9)


def _same(a: list, b: list) -> bool:
    return a[SIG] == b[SIG] and a[KIND] == b[KIND] and (a[SIG] != "()" or [k[SIG] for k in a[KIDS]] == [k[SIG] for k in b[KIDS]])


def _merge(a: list, b: list, fold: bool = False) -> list:
    """Generalize two nodes of the same signature; ``fold``: they are repetitions on one page."""
    return [a[SIG], a[TAG], a[KIND], a[OPT] or b[OPT], a[REP] or b[REP] or fold, a[CHARS] + b[CHARS],
            a[LINKED] + b[LINKED], a[TEXT] if a[TEXT] == b[TEXT] else None, align(a[KIDS], b[KIDS])]


def align(a: list, b: list) -> list:
    """Align two token sequences: common tokens merge, the others become optional, repetitions fold."""
    if not a or not b or (len(a) == len(b) and all(map(_same, a, b))):
        if not a or not b:
            return [x[:OPT] + [True] + x[REP:] for x in a or b]
        return [_merge(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for x, y in (*_common(a, b), (len(a), len(b))):
        out += [k[:OPT] + [True] + k[REP:] for k in (*a[i:x], *b[j:y])]
        if x < len(a) and y < len(b):
            out.append(_merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return squash(out)


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a common subsequence: the longest one, unless its table would have over CELLS cells.

    Longer lists are first cut at the tokens that occur once in each, in the longest run of these that has the same
    order in both; a stretch that is still too long has nothing in common then.
    """
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and _same(a[lo], b[lo]):
        lo += 1
    while hi < min(len(a), len(b)) - lo and _same(a[-1 - hi], b[-1 - hi]):
        hi += 1
    n, m = len(a) - lo - hi, len(b) - lo - hi
    middle: list[tuple[int, int]] = []
    if n and m and n * m <= CELLS:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(m - 1, -1, -1):
                row[j] = below[j + 1] + 1 if _same(a[lo + i], b[lo + j]) else max(below[j], row[j + 1])
        i = j = 0
        while i < n and j < m:
            if _same(a[lo + i], b[lo + j]):
                middle.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    elif n and m:
        x, y = lo, lo
        for p, q in (*_anchors(a, b, lo, lo + n, lo + m), (lo + n, lo + m)):
            if (p - x) * (q - y) <= CELLS:
                middle += [(x + i, y + j) for i, j in _common(a[x:p], b[y:q])]
            if p < lo + n:
                middle.append((p, q))
            x, y = p + 1, q + 1
    return [(i, i) for i in range(lo)] + middle + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]


def _anchors(a: list, b: list, lo: int, a_end: int, b_end: int) -> list[tuple[int, int]]:
    """The longest ascending run of places of tokens that are unique on both sides."""
    name = lambda k: (k[SIG], k[KIND], tuple(x[SIG] for x in k[KIDS]) if k[SIG] == "()" else ())
    places: list[dict] = []
    for side, end in ((a, a_end), (b, b_end)):
        seen: dict = {}
        for i in range(lo, end):
            seen[name(side[i])] = None if name(side[i]) in seen else i
        places.append({k: i for k, i in seen.items() if i is not None})
    both = sorted((i, places[1][k]) for k, i in places[0].items() if k in places[1])
    ends: list[int] = []                                      # smallest last place of a run of each length
    last: list[int] = []
    before: list[int] = []
    for at, (_, j) in enumerate(both):
        k = bisect.bisect_left(ends, j)
        ends[k:k + 1], last[k:k + 1] = [j], [at]
        before.append(last[k - 1] if k else -1)
    run, at = [], last[-1] if last else -1
    while at >= 0:
        run.append(both[at])
        at = before[at]
    return run[::-1]


def squash(kids: list) -> list:
    """Fold adjacent repetitions, of one token first, then of groups of several."""
    out: list = []
    for k in kids:
        if out and _same(out[-1], k):
            out[-1] = _merge(out[-1], k, fold=True)
        else:
            out.append(k)
    for period in range(2, MAX_PERIOD + 1):
        i = 0
        while i + period < len(out):
            if out[i][SIG] == "()" and len(out[i][KIDS]) == period and i + 1 + period <= len(out) \
                    and all(map(_same, out[i][KIDS], out[i + 1:i + 1 + period])):
                group = out[i + 1:i + 1 + period]
                out[i:i + 1 + period] = [_merge(out[i], ["()", "", "", False, True, 0, 0, None, group], fold=True)]
            elif i + 2 * period <= len(out) and all(map(_same, out[i:i + period], out[i + period:i + 2 * period])):
                group = [_merge(x, y) for x, y in zip(out[i:i + period], out[i + period:i + 2 * period])]
                out[i:i + 2 * period] = [["()", "", "", False, True, 0, 0, None, group]]
            else:
                i += 1
    return out


def _digest(text: str) -> str:
    """The text itself if it is short, else its hash."""
    return text if len(text) <= 32 else "#" + hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).hexdigest()


def shape(e: Element, linked: bool = False) -> list:
    """A page's stream as tokens with its repetitions folded."""
    out = []
    for k in e.kids:
        if isinstance(k, str):
            if t := " ".join(k.split()):
                out.append(["#", "", "", False, False, len(t), len(t) if linked else 0, _digest(t), []])
        elif k.kind == "-":
            out.append([k.sig, k.tag, "-", False, False, 0, 0, None, []])     # furniture is not looked into
        else:
            out.append([k.sig, k.tag, k.kind, False, False, 0, 0, None, shape(k, linked or k.tag == "a")])
    return squash(out)


def _strip(nodes: list, slots: list) -> list:
    """The shape without its counts, which go to ``slots`` in order."""
    out = []
    for x in nodes:
        slots.append((x[CHARS], x[LINKED], x[TEXT]))
        out.append(x[:CHARS] + [0, 0, None, _strip(x[KIDS], slots)])
    return out


def _fill(nodes: list, slots: Iterator) -> None:
    for x in nodes:
        x[CHARS], x[LINKED], x[TEXT] = next(slots)
        _fill(x[KIDS], slots)


def expression(nodes: list) -> str:
    """The wrapper as a regular expression over tags and # for text slots."""
    out = []
    for x in nodes:
        body = expression(x[KIDS])
        if x[SIG] == "#":
            s = "#"
        elif x[SIG] == "()":
            s = f"({body})"
        else:
            s = f"<{x[SIG]}>{body}</{x[TAG]}>" if body else f"<{x[SIG]}/>"
        mark = "*" if x[OPT] and x[REP] else "+" if x[REP] else "?" if x[OPT] else ""
        out.append(f"({s}){mark}" if mark and not s.startswith("(") else s + mark)
    return "".join(out)


def _free_text(x: list) -> int:
    """Characters of a node outside links, furniture and fixed texts."""
    if x[KIND] == "-":
        return 0
    own = x[CHARS] - x[LINKED] if x[SIG] == "#" and x[TEXT] is None else 0
    return own + sum(map(_free_text, x[KIDS]))


def kept_paths(wrapper: list) -> list[list[str]]:
    """Paths of the wrapper's article parts, as alternatives in order of preference.

    Outermost articles, then <main>, then other marks (each cut to the articles inside that hold most of its text, then
    whole), then the richest part of what is not marked, the next richest, and so on.
    """
    marked: list[tuple[str, list]] = []

    def find(nodes: list, path: str) -> None:
        for x in nodes:
            here = path if x[SIG] == "()" else f"{path}/{x[SIG]}"
            if x[KIND] == "+":
                marked.append((here, x))
            elif x[KIND] != "-" and x[SIG] != "#":
                find(x[KIDS], here)

    def narrow(path: str, x: list) -> list[str]:         # <main> or a content division around articles: the articles
        articles: list[tuple[str, list]] = []

        def look(nodes: list, p: str) -> None:
            for y in nodes:
                q = p if y[SIG] == "()" else f"{p}/{y[SIG]}"
                if y[TAG] == "article" and y[KIND] == "+":
                    articles.append((q, y))
                elif y[KIND] != "-" and y[SIG] != "#":
                    look(y[KIDS], q)
        if x[TAG] != "article":
            look(x[KIDS], path)
        if articles and 2 * sum(_free_text(y) for _, y in articles) >= _free_text(x):
            return [q for q, _ in articles]
        return [path]
    find(wrapper, "")
    articles = [(p, x) for p, x in marked if x[TAG] == "article"]
    mains = [(p, x) for p, x in marked if x[TAG] == "main" or x[SIG].endswith("@main")]
    out: list[list[str]] = []
    for group in (articles, mains, [m for m in marked if m not in articles and m not in mains]):
        for paths in ({q for p, x in group for q in narrow(p, x)}, {p for p, _ in group}):
            if paths and sorted(paths) not in out:
                out.append(sorted(paths))
    gone = [x for _, x in marked]                        # parts that an alternative has

    def free(x: list) -> int:
        if x[KIND] == "-" or any(x is y for y in gone):
            return 0
        return _free_text([*x[:KIDS], []]) + sum(map(free, x[KIDS]))
    while True:                                          # no marks: go down while one child holds most of the text
        path, nodes, part = "", wrapper, None
        while True:
            rich = [(x, free(x)) for x in nodes if x[SIG] != "#"]
            total = sum(map(free, nodes))
            top = max(rich, key=lambda r: r[1], default=None)
            if not top or not total or top[1] < 0.7 * total or top[0][TAG] in ("p", "li", *HEADINGS):
                break
            path, nodes, part = (path if top[0][SIG] == "()" else f"{path}/{top[0][SIG]}"), top[0][KIDS], top[0]
        if not path or not total:
            return out
        if [path] not in out:
            out.append([path])
        gone.append(part)


def main_text(page: str | None, alternatives: list[list[str]]) -> str:
    """The text of the parts of ``page`` on the paths of the first alternative that it has, furniture left out.

    A page that has none of them keeps all its text in elements outside links and furniture.
    """
    if not page:
        return ""
    root = parse(page)
    for paths in alternatives:
        if text := _text_on(root, set(paths)):
            return text
    return _text_on(root, None)


def _text_on(root: Element, paths: set[str] | None) -> str:
    """The text of the parts on ``paths``; None: of all parts but links."""
    blocks: list[list[str]] = [[]]

    def walk(e: Element, path: str, inside: bool, heads_only: bool) -> None:
        for k in e.kids:
            if isinstance(k, str):
                if inside and not heads_only:
                    blocks[-1].append(k)
                continue
            here = f"{path}/{k.sig}"
            if paths is None and k.tag == "a":
                continue
            keep = inside or paths is None or here in paths
            only = heads_only
            if k.kind == "-":
                if not (keep and k.tag == "header" and paths is not None):
                    continue
                only = True                            # an article's own header: its headings are text
            if k.tag in HEADINGS:
                only = False
            if k.tag == "br":
                blocks[-1].append(" ")
            elif k.tag in BLOCKS:
                blocks.append([])
                walk(k, here, keep, only)
                blocks.append([])
            else:
                walk(k, here, keep, only)
    walk(root, "", False, False)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(x for x in lines if x)


HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count the shapes of a batch's pages: a row for each host and shape, with its slots' sums.

    ``pages`` holds hashes of up to FIXED_PAGES pages that differ in a text.
    """
    for f in frames:
        seen: dict[tuple[str, str], list] = {}
        for host, page in zip(f["host"], f["page"]):
            if not page:
                continue
            slots: list = []
            key = (host, json.dumps(_strip(shape(parse(page)), slots), ensure_ascii=False))
            one = hashlib.blake2b(repr([x[2] for x in slots]).encode(errors="surrogatepass"), digest_size=8)
            one = int.from_bytes(one.digest(), "big", signed=True)
            if key not in seen:
                seen[key] = [{one}, slots]
            else:
                have = seen[key]
                if len(have[0]) < FIXED_PAGES:
                    have[0].add(one)
                have[1] = [(a + c, b + d, t if t == u else None) for (a, b, t), (c, d, u) in zip(have[1], slots)]
        yield pd.DataFrame([(h, s, sorted(v[0]), [x[0] for x in v[1]], [x[1] for x in v[1]], [x[2] for x in v[1]])
                            for (h, s), v in seen.items()],
                           columns=["host", "shape", "pages", "chars", "linked", "texts"])


def _wrap(f: pd.DataFrame) -> pd.DataFrame:
    """Merge the wrappers of a group, in order."""
    merged: list | None = None
    for w in sorted(f["wrapper"]):
        w = json.loads(w)
        merged = w if merged is None else align(merged, w)
    return pd.DataFrame([(f["host"].iloc[0], json.dumps(merged, ensure_ascii=False))], columns=["host", "wrapper"])


def _first_wrapper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A shape and its summed slots as a wrapper."""
    for f in batches:
        rows = []
        for host, s, n, slots in zip(f["host"], f["shape"], f["n"], f["slots"]):
            nodes = json.loads(s)
            by = {x["slot"]: (int(x["chars"]), int(x["linked"]),
                              x["lo"] if x["fixed"] and n >= FIXED_PAGES else None) for x in slots}
            _fill(nodes, iter([by[i] for i in range(len(by))]))
            rows.append((host, json.dumps(nodes, ensure_ascii=False)))
        yield pd.DataFrame(rows, columns=["host", "wrapper"])


def wrappers(pages: DataFrame, folder: str, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper, expression, paths) of every host with a page."""
    src = pages.select(host_of(url).alias("host"), F.col(f"`{html}`").alias("page"))
    part = src.mapInPandas(_shapes, "host string, shape string, pages array<bigint>, chars array<bigint>, "
                                    "linked array<bigint>, texts array<string>")
    part = write_table(part, folder, "shapes")
    slots = part.select("host", "shape", "pages", F.posexplode(F.arrays_zip("chars", "linked", "texts")).alias("slot", "v"))
    same = (F.min("v.texts") == F.max("v.texts")) & (F.count("v.texts") == F.count("*"))
    slots = slots.groupBy("host", "shape", "slot").agg(
        # a few hashes of each batch, at the first slot only
        F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("slot") == 0, F.col("pages")))))).alias("n"),
        F.sum("v.chars").alias("chars"), F.sum("v.linked").alias("linked"),
        F.min("v.texts").alias("lo"), F.coalesce(same, F.lit(False)).alias("fixed"))
    whole = slots.groupBy("host", "shape").agg(          # bounded by the slots of one shape
        F.max("n").alias("n"), F.collect_list(F.struct("slot", "chars", "linked", "lo", "fixed")).alias("slots"))
    w = write_table(whole.mapInPandas(_first_wrapper, "host string, wrapper string"), folder, "wrappers-0")
    step = 0
    while True:
        many = w.groupBy("host").agg(F.count("*").alias("k"))
        if not many.where("k > 1").limit(1).count():
            break
        step += 1
        # groups of about FAN_IN wrappers: merged until each host has one
        groups = many.select(F.col("host").alias("h"), F.ceil(F.col("k") / FAN_IN).alias("groups"))
        dealt = w.join(groups, null_safe(F.col("host"), F.col("h"))).withColumn(
            "group", F.pmod(F.xxhash64("wrapper", F.lit(step)), F.col("groups"))).select("host", "group", "wrapper")
        w = write_table(dealt.groupBy("host", "group").applyInPandas(_wrap, "host string, wrapper string"),
                        folder, f"wrappers-{step}")

    @F.udf("struct<expression: string, paths: array<array<string>>>", useArrow=True)
    def read(wrapper: str):
        nodes = json.loads(wrapper)
        return expression(nodes), kept_paths(nodes)
    return write_table(w.withColumn("r", read("wrapper")).select("host", "wrapper", "r.expression", "r.paths"),
                       folder, "hosts")


def host_of(url: str):
    """Lower-case host of a URL column; null where there is none."""
    found = F.lower(F.regexp_extract(F.col(f"`{url}`"), HOST, 1))
    return F.when(found != "", found)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without their html, with ``text`` and ``n_chars`` (its code points)."""
    folder = work_folder(pages.sparkSession, "html")
    w = wrappers(pages, folder, url, html).select(F.col("host").alias(fresh_name(pages, "host")),
                                                  F.col("paths").alias(fresh_name(pages, "paths")))
    h, p = w.columns

    @F.udf("string", useArrow=True)
    def text_of(page, paths):
        return main_text(page, paths if paths is not None else [])
    out = pages.join(w, null_safe(host_of(url), F.col(h)), "left")
    out = out.withColumn(p, text_of(F.col(f"`{html}`"), F.col(p)))
    rest = [c for c in pages.columns if c != html and c.lower() not in ("text", "n_chars")]
    return out.select(*[F.col(f"`{c}`") for c in rest], F.col(p).alias("text"),
                      F.length(p).cast("bigint").alias("n_chars"))
