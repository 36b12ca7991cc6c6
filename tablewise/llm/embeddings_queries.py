"""Query of the embedding near-duplicates."""

from tablewise.llm import embeddings
from tablewise.llm.common import table
from tablewise.llm.registry import query

SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding, embedding) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.node WHERE r.root < l.v),
c AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
n AS (SELECT u, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON u = vec_id LEFT JOIN c ON node = vec_id"""


@query("op10_embedding_near_duplicates", SQL)
def op10(spark, sf_dir):
    return embeddings.classes(table(spark, sf_dir, "embeddings"))
