"""Query of the SimHash near-duplicates."""

from pyspark.sql import functions as F

from tablewise.llm import simhash
from tablewise.llm.common import table
from tablewise.llm.registry import query


@query("op7_simhash_near_duplicates")
def op7(spark, sf_dir):
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
