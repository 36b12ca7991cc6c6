"""Query of the mixing of sources."""

from tablewise.llm import mixing
from tablewise.llm.common import table
from tablewise.llm.registry import query


@query("op1_pfair_mixing")
def op1(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))
