"""Query of the substring deduplication."""

from tablewise.llm import substring
from tablewise.llm.common import table
from tablewise.llm.registry import query

SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
s AS (
  SELECT doc_id, i, md5(string_agg(x, ' ') OVER d) AS content, count(*) OVER d AS n
  FROM g WINDOW d AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY content) AS least FROM s WHERE n = 50),
c AS (
  SELECT g.doc_id, g.i, g.x,
         coalesce(max(m.i) FILTER (m.least < m.doc_id) OVER (PARTITION BY g.doc_id ORDER BY g.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM g LEFT JOIN m USING (doc_id, i)),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""


@query("op2_substring_dedup", SQL)
def op2(spark, sf_dir):
    return substring.digests(table(spark, sf_dir, "documents"))
