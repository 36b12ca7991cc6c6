"""Query of the ranked search."""

from tablewise.llm import ranking
from tablewise.llm.common import table
from tablewise.llm.registry import query

SQL = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(body, '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts FROM low),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
o AS (SELECT doc_id, t, len(ts) AS n, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM o, c GROUP BY t, n_docs),
i AS (SELECT item_id, translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM benchmark WHERE item_id IS NOT NULL GROUP BY 1),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(body, '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM i) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN o USING (t) JOIN f USING (t), c WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""


@query("op11_ranked_search", SQL)
def op11(spark, sf_dir):
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
