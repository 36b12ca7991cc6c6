"""Connected components of a link table by alternating large and small stars, in Spark throughout.

Each round replaces links by links to the smallest neighbour; a round costs two aggregations and two
joins over the links, and the number of rounds grows with the logarithm of the longest chain. Hubs are
combined before every shuffle (minimum) and join one row of minima, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import by_value, discard, store

by_value(__name__)


def _large(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``u``, ``v``) but the roots; root is the smallest node.

    Links of a node to itself and repeated links do no harm; nulls must be left out before. Without
    links the result is empty.
    """
    now = store(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == state or not sums[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = sums
        then = store(_small(_large(now)), "links")
        discard(now)
        now = then
