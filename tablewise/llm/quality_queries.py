"""Query of the quality rules."""

from tablewise.llm import quality
from tablewise.llm.common import table
from tablewise.llm.registry import query

SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT doc_id, i, x || ' ' || lead(x) OVER d || ' ' || lead(x, 2) OVER d AS gram FROM g WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM k WHERE gram IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE k > 1) GROUP BY 1),
c AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^!?]', '', 'g'))::BIGINT AS n_shouts,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         least(n_symbols * 1000 // greatest(word_chars, 1), 1000) AS symbols,
         least(n_shouts * 1000 // greatest(word_chars, 1), 1000) AS shouts,
         least(n_dup_lines * 1000 // greatest(n_lines, 1), 1000) AS dup_lines,
         least(n_repeat_words * 1000 // greatest(n_words, 1), 1000) AS repeats,
         least(word_chars * 10 // greatest(n_words, 1), 1000) AS length
  FROM c),
u AS (UNPIVOT (SELECT lang, source, symbols, shouts, dup_lines, repeats, length FROM f WHERE NOT base_failed)
      ON symbols, shouts, dup_lines, repeats, length INTO NAME feature VALUE bin),
o AS (SELECT lang, source, feature, count(*) AS n, quantile_disc(bin, 0.125) AS lo, quantile_disc(bin, 0.875) AS hi FROM u GROUP BY ALL),
l AS (SELECT lang, feature, count(*) AS n, quantile_disc(bin, 0.125) AS lo, quantile_disc(bin, 0.875) AS hi FROM u GROUP BY ALL),
a AS (SELECT feature, quantile_disc(bin, 0.125) AS lo, quantile_disc(bin, 0.875) AS hi FROM u GROUP BY ALL),
m AS (SELECT lang, feature, (n * l.lo + 200 * a.lo) // (n + 200) AS lo, (n * l.hi + 200 * a.hi) // (n + 200) AS hi FROM l JOIN a USING (feature)),
q AS (SELECT o.lang, source, feature, (n * o.lo + 200 * m.lo) // (n + 200) AS lo, (n * o.hi + 200 * m.hi) // (n + 200) AS hi
      FROM o JOIN m USING (lang, feature)),
t AS (
  SELECT lang, source, max(hi + 3 * (hi - lo) + 5) FILTER (feature = 'symbols') AS hs,
         max(hi + 3 * (hi - lo) + 5) FILTER (feature = 'shouts') AS hx, max(hi + 3 * (hi - lo) + 5) FILTER (feature = 'dup_lines') AS hd,
         max(hi + 3 * (hi - lo) + 5) FILTER (feature = 'repeats') AS hr, max(hi + 3 * (hi - lo) + 5) FILTER (feature = 'length') AS hl,
         max(lo - 3 * (hi - lo) - 5) FILTER (feature = 'length') AS ll
  FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND length BETWEEN ll AND hl
                AND 1000 * (n_symbols - 5) <= hs * word_chars AND 1000 * (n_shouts - 5) <= hx * word_chars
                AND 1000 * (n_dup_lines - 3) <= hd * n_lines AND 1000 * (n_repeat_words - 60) <= hr * n_words, false) AS kept
FROM f LEFT JOIN t USING (lang, source)"""


@query("op5_quality_rules", SQL)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.quality(docs, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
