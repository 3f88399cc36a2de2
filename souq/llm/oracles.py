"""DuckDB statements that compute the operators' results directly from the tables."""

#: Sorted running sums by hash instead of histograms; the water level by the closed form over sorted caps.
MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce('=' || CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w FROM s0),
s2 AS (SELECT *, 3 * source_size AS cap, 3.0::DOUBLE * source_size / w AS full_at FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
              sum(w) OVER (ORDER BY full_at, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
              sum(source_size) OVER () AS total FROM s2),
lv AS (SELECT arg_min((total - held)::DOUBLE / free::DOUBLE, full_at) AS level FROM s3 WHERE (total - held)::DOUBLE / free::DOUBLE <= full_at),
t AS (SELECT source, source_size, least(w * level, cap::DOUBLE) AS target FROM s3, lv),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
l AS (SELECT *, target - copies * source_size AS room0 FROM b),
r1 AS (SELECT d.*, l.source_size, l.target, l.copies, l.room0,
              sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
       FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
r2 AS (SELECT *, upto <= room0 AS one, room0 - max(CASE WHEN upto <= room0 THEN upto ELSE 0 END) OVER (PARTITION BY source) AS room FROM r1),
r3 AS (SELECT *, sum(CASE WHEN NOT one AND size <= room THEN size ELSE 0 END)
              OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto2 FROM r2)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       size::BIGINT * (copies + CASE WHEN one OR (size <= room AND upto2 <= room) THEN 1 ELSE 0 END) AS taken
FROM r3
"""

_LINE_FAILS = r"""(
   NOT regexp_matches(x, '[.!?…。！？]["'')\]»”’]*([\x20\x09-\x0D]|\z)')
   OR 2 * len(regexp_extract_all(x, '[!?]{2,}([\x20\x09-\x0D]|\z)')) > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
   OR 4 * len(list_filter(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), lambda w: regexp_full_match(w, '[|>»•·›/]+'))) >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
   OR 10 * len(regexp_extract_all(x, '[#*$%&|<>]')) > length(x)
   OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 20 AND regexp_matches(x, '(?i)(javascript|cookies? policy|use of cookies|accept (all )?cookies|all rights reserved|privacy policy|terms (of|and) (use|service|conditions)|lorem ipsum|sign in|log ?in|subscribe (now|to)|newsletter|click here|read more|share (this|on)|back to top|powered by|skip to (main )?content|\bcopyright\b|©)')))"""

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT k, i, list_slice(w, i, i + 7) AS g FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
c AS (SELECT *, count(*) OVER (PARTITION BY k, g) AS n FROM g),
r AS (SELECT k, count(DISTINCT i + j) AS n FROM c, range(0, 8) AS o(j) WHERE n > 1 GROUP BY 1),
l AS (SELECT k, x, rn FROM (SELECT k, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS rn FROM d)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
f AS (SELECT k, x, {_LINE_FAILS} AS fails FROM l),
n AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines, sum(fails::INT) AS n_removed,
             1 - sum(CASE WHEN fails THEN 0 ELSE length(x) END)::DOUBLE / sum(length(x)) AS lost FROM f GROUP BY 1),
a AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
             coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(lost, 0) AS lost
      FROM d LEFT JOIN r ON d.k = r.k LEFT JOIN n ON d.k = n.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_removed,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.5) AS kept
FROM a
"""
