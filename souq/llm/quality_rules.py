"""Quality rules: line-first cleaning with built-in functions only.

Every line is judged by itself - sentence punctuation, navigation, boilerplate
- and failing lines are taken out; a document that loses more than
``max_lost`` of its text that way is rejected, as is one that fails the base
rules (too few words, or too many words inside repeated 8-word windows).

Null text: no words, base_failed, rejected.  Empty and blank texts likewise.
Lines without a word are kept and count for nothing.  Repeated rows are judged
row by row; there is no join and no shuffle, so other columns (of any name)
pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souq.llm.common import WORD

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"
NON_BLANK = r"[^\x20\x09-\x0D]"
#: A sentence end: a mark, closing quotes or brackets, then white space or the line's end.
SENTENCE_END = r"[.!?…。！？][\"')\]»”’]*(?:[\x20\x09-\x0D]|\z)"
SHOUT = r"[!?]{2,}(?:[\x20\x09-\x0D]|\z)"
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|>»•·›/]+(?=[\x20\x09-\x0D]|\z)"
#: Phrases of page furniture; a line of at most BOILERPLATE_WORDS words with one fails.
BOILERPLATE = (r"(?i)(?:javascript|cookies? policy|use of cookies|accept (?:all )?cookies|all rights reserved"
               r"|privacy policy|terms (?:of|and) (?:use|service|conditions)|lorem ipsum|sign in|log ?in"
               r"|subscribe (?:now|to)|newsletter|click here|read more|share (?:this|on)|back to top"
               r"|powered by|skip to (?:main )?content|\bcopyright\b|©)")
BOILERPLATE_WORDS = 20
MAX_LOST = 0.5


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def line_fails(line: Column) -> Column:
    """The per-line rules on a line that has a word."""
    n = F.regexp_count(line, F.lit(WORD))
    chars = F.length(line)
    punctuation = ~line.rlike(SENTENCE_END) | (2 * F.regexp_count(line, F.lit(SHOUT)) > n)
    navigation = 4 * F.regexp_count(line, F.lit(SEPARATOR)) >= n
    symbols = 10 * F.regexp_count(line, F.lit(SYMBOLS)) > chars
    boilerplate = (n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    return punctuation | navigation | symbols | boilerplate


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in order.

    Sorting (hash, position) puts equal windows side by side; the positions of
    windows with an equal neighbour, sorted again, cover min(8, gap to the
    next) words each.
    """
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # the sorted array is bound once as the accumulator of a one-step aggregate
    def covered(s: Column) -> Column:
        same = lambda e, k: F.when((k >= 0) & (k < F.size(s)), F.get(s, k)["h"] == e["h"]).otherwise(False)
        twice = F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return F.array_sort(F.transform(twice, lambda e: e["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return bind(ordered, lambda s: bind(covered(s), total))


def judge(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST, prefix: str = "q_") -> DataFrame:
    """``docs`` with the rule columns added, each name beginning with ``prefix``:

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines (with a word), n_removed (failing lines), lost (share of text lost),
    clean (the text without failing lines; null where text is null), kept.
    """
    p = lambda name: f"{prefix}{name}"
    c = lambda name: F.col(f"`{prefix}{name}`")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def word_part(w: Column) -> Column:
        n = F.size(w)
        windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))),
                                                 lambda i: F.xxhash64(F.slice(w, i, WINDOW))))
        repeat = bind(windows, lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)),
                                                F.lit(0).cast("bigint")).otherwise(_repeat_words(h)))
        return F.struct(n.cast("bigint").alias("n_words"),
                        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                        repeat.alias("n_repeat_words"))

    def line_part(lines: Column) -> Column:
        full = F.filter(lines, lambda x: x.rlike(NON_BLANK))
        good = F.filter(lines, lambda x: ~x.rlike(NON_BLANK) | ~line_fails(x))

        def sums(f: Column, g: Column) -> Column:
            solid = F.filter(g, lambda x: x.rlike(NON_BLANK))
            size = lambda a: F.length(F.array_join(a, "")).cast("double")
            return F.struct((F.size(f) - F.size(F.array_distinct(f))).cast("bigint").alias("n_dup_lines"),
                            F.size(f).cast("bigint").alias("n_lines"),
                            (F.size(f) - F.size(solid)).cast("bigint").alias("n_removed"),
                            F.when(F.size(f) > 0, 1 - size(solid) / size(f)).otherwise(F.lit(0.0)).alias("lost"),
                            F.array_join(g, "\n").alias("clean"))
        return bind(full, lambda f: bind(good, lambda g: sums(f, g)))

    out = docs.withColumns({p("w"): bind(_words(t), word_part), p("l"): bind(F.split(t, "\n"), line_part),
                            p("n_symbols"): F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint")})
    out = out.withColumns({p(k): c("w")[k] for k in ("n_words", "word_chars", "n_repeat_words")}
                          | {p(k): c("l")[k] for k in ("n_dup_lines", "n_lines", "n_removed", "lost")}
                          | {p("clean"): F.when(F.col(f"`{text}`").isNotNull(), c("l")["clean"])})
    out = out.withColumn(p("base_failed"), (c("n_words") < MIN_WORDS)
                         | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words")))
    return out.withColumn(p("kept"), ~c("base_failed") & (c("lost") <= max_lost)).drop(p("w"), p("l"))


def clean(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars",
          max_lost: float = MAX_LOST) -> DataFrame:
    """The documents that pass, failing lines removed from their text; same columns as ``docs``."""
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    out = judge(docs, text, max_lost, prefix).where(f"`{prefix}kept`")
    cols = []
    for name in docs.columns:
        if name == text:
            cols.append(F.col(f"`{prefix}clean`").alias(name))
        elif n_chars and name == n_chars:
            cols.append(F.length(f"{prefix}clean").cast(docs.schema[name].dataType).alias(name))
        else:
            cols.append(F.col(f"`{name}`"))
    return out.select(*cols)
