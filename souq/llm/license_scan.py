"""License scans by conditional compression.

The words around a mention of licensing (a template's length and a half on both
sides) are laid beside each template: the words missing from and added to it,
by a longest common subsequence, cut the block to the template's first and last
word found.  That block is compressed alone and with the template as a raw
zstandard dictionary; nothing around the notice drowns the bytes spared.  A
block is a match when the template spares a share of ``min_reduction`` of the
bytes and the share of the template's words that it lacks is at most
``max_missing``; it is exact when none is missing or added.  What stands left
and right of a match is looked at again, so every notice of a line is found.

A notice may be wrapped over lines, with marks of comments at their starts.  It
may lack words, but none that names the licence or its version (words with a
digit, or capitalized inside the template).

Built-in functions find the texts with a candidate, so only those reach Python.
The whole of every text is looked at.  Null, empty and blank texts
have no block.  Equal notices of one text are separate rows.  Of templates that
explain the same words (the GPL's within the LGPL's) the one with fewer words
missing, then added, then the larger reduction, then the name stays.
Extra columns are not read.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Notices as they are printed by convention.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
}
#: What may stand between two words of a notice: blanks, line ends, marks of comments.
GAP = r"[\s#*/;%>|-]+"
GAP_LINES = r"[ \t]*\n[\s#*/;%>|-]*"
#: A notice that lacks some words still has one of these.
CANDIDATE = (r"(?i)licen[sc]|all rights reserved|public domain|copyright|redistribution and use|source and binary forms"
             r"|with or without modification|are permitted provided|conditions are met|\bcc0\b|\bcc by\b").replace(" ", GAP)
LEVEL = 3
MIN_REDUCTION = 0.3
MAX_MISSING = 0.2                   # of the template's words, but none that names the licence or its version
SCHEMA = ("key bigint, line int, license string, reduction double, n_missing int, n_added int, "
          "exact boolean, missing string, added string, block string")


WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _names(text: str) -> set[str]:
    """Words that name a licence or its version: with a digit, or capitalized inside the notice."""
    words = WORD.findall(text)
    return {w.lower() for i, w in enumerate(words) if re.search(r"\d", w) or (i and w != w.lower())}


def wording(template: list[str], block: list[str]) -> tuple[list[str], list[str], list[int]]:
    """Words of the template that the block lacks, the words between the matches that it adds, the matches' places."""
    blocks = difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks()
    met = {a + i for a, _, n in blocks for i in range(n)}
    places = [b + i for _, b, n in blocks for i in range(n)]
    missing = [w for i, w in enumerate(template) if i not in met]
    inside = set(places)         # what stands before and after the notice is not part of it
    return missing, [block[i] for i in range(places[0], places[-1]) if i not in inside] if places else [], places


class Scanner:
    """Compressors for each template as a raw dictionary."""

    def __init__(self, templates: dict[str, str], max_missing: float, min_reduction: float):
        self.max_missing, self.min_reduction = max_missing, min_reduction
        self.candidate = re.compile(CANDIDATE)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.items = []
        for name in sorted(templates):
            d = zstandard.ZstdCompressionDict(templates[name].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words = _words(templates[name])
            self.items.append((name, words, _names(templates[name]), int(max_missing * len(words) + 1e-9), len(templates[name].encode()),
                               zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                        write_dict_id=False)))

    def _search(self, text: str, words: list[str], spans: list[tuple[int, int]], lo: int, hi: int, item: tuple,
                found: dict) -> None:
        """Add the template's notices among the words from ``lo`` to ``hi`` to ``found``."""
        name, template, names, most, size, with_template = item
        block = words[lo:hi]
        have = set(block)
        if not names <= have or sum(w not in have for w in template) > most:       # no wording can be close enough
            return
        missing, added, places = wording(template, block)
        if not places or len(missing) > most or not names.isdisjoint(missing):
            return
        at = tuple(lo + i for i in places)
        if (name, at) not in found:
            raw = re.sub(GAP_LINES, " ", text[spans[at[0]][0]:spans[at[-1]][1] + 1]).encode()
            alone = len(self.plain.compress(raw))
            spared = (alone - len(with_template.compress(raw))) / min(size, alone)
            found[name, at] = (spared, missing, added)
        self._search(text, words, spans, lo, at[0], item, found)
        self._search(text, words, spans, at[-1] + 1, hi, item, found)

    def scan(self, text: str) -> list[tuple]:
        """(first byte's place, end, license, reduction, missing words, added words) of every notice, in order."""
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        ends = [b for _, b in spans]
        found: dict[tuple, tuple] = {}
        for m in self.candidate.finditer(text):
            at = bisect.bisect_right(ends, m.start())
            to = max(at + 1, bisect.bisect_left(ends, m.end()) + 1)
            for item in self.items:
                reach = len(item[1]) + len(item[1]) // 2 + 2
                lo, hi = max(0, at - reach), min(len(words), to + reach)
                self._search(text, words, spans, lo, hi, item, found)
        kept: list[tuple] = []
        for (name, at), v in sorted(found.items(), key=lambda f: (len(f[1][1]), len(f[1][2]), -f[1][0], f[0])):
            if v[0] < self.min_reduction:
                continue
            here = set(at)
            if not any(here & other if name == n else here <= other for n, other, _ in kept):
                kept.append((name, here, (spans[at[0]][0], spans[at[-1]][1], name, *v)))
        return sorted(row for _, _, row in kept)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
         max_missing: float = MAX_MISSING, min_reduction: float = MIN_REDUCTION) -> DataFrame:
    """One row for each notice: key, its first line (from 0), license, reduction, the wording differences, its lines."""
    templates = dict(templates or TEMPLATES)
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t")) \
        .where(F.col("t").rlike(CANDIDATE))

    kind = texts.schema["key"].dataType

    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, max_missing, min_reduction)
        for f in frames:
            rows = []
            for k, t in zip(f["key"], f["t"]):
                feeds = [m.start() for m in re.finditer("\n", t)]
                for start, end, name, spared, missing, added in scanner.scan(t):
                    line, last = bisect.bisect_left(feeds, start), bisect.bisect_left(feeds, end)
                    block = t[feeds[line - 1] + 1 if line else 0:feeds[last] if last < len(feeds) else len(t)]
                    rows.append((k, line, name, spared, len(missing), len(added), not missing and not added,
                                 " ".join(missing), " ".join(added), block))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            if isinstance(kind, IntegralType):
                out["key"] = out["key"].astype("Int64")
            yield out
    return texts.mapInPandas(confirm, SCHEMA.replace("bigint", kind.simpleString(), 1))
