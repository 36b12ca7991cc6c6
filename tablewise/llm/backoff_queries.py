"""Query of the language-model scores."""

from tablewise.llm import backoff
from tablewise.llm.common import table
from tablewise.llm.registry import query


@query("op4_stupid_backoff")
def op4(spark, sf_dir):
    return backoff.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
