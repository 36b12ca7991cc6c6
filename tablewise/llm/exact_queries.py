"""Query of the exact duplicates."""

from pyspark.sql import functions as F

from tablewise.llm import exact
from tablewise.llm.common import table
from tablewise.llm.registry import query

SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, sha256(body) AS text_sha256
      FROM t WINDOW same AS (PARTITION BY body))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""


@query("op13_exact_dedup", SQL)
def op13(spark, sf_dir):
    sha = F.sha2(exact.normal(F.col("text")), 256).alias("text_sha256")
    return exact.groups(table(spark, sf_dir, "documents"), also=[sha])
