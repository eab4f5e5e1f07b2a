"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import settle


def components(links: DataFrame, purpose: str) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    ``links`` has (node, to), to < node. Each round hangs neighbours below the
    smallest one, with a minimum per node and a join, so a node with many links
    never meets in one task; rounds are written, so no lineage builds up.
    """
    links = settle(links.distinct(), purpose)
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        large = both.join(least, "node").where("to > node").select(F.col("to").alias("node"), F.col("least").alias("to"))
        large = settle(large.distinct(), purpose)
        least = large.groupBy("node").agg(F.min("to").alias("least"))
        small = large.join(least, "node").where("to <> least").select(F.col("to").alias("node"), F.col("least").alias("to"))
        links = settle(small.unionByName(least.withColumnRenamed("least", "to")).distinct(), purpose)
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "to"))).first()
        if now == seen:
            return links.withColumnRenamed("to", "root")
        seen = now
