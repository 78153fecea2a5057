"""Connected components of a table of links, by rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import meet, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of `links` (a, b) is connected with.

    Alternates large-star and small-star: every node's greater neighbours, then its
    smaller ones and itself, are hung on its smallest neighbour, until each component is a
    star. Every round is a grouped minimum (summed before the shuffle) and a join whose
    skewed partitions Spark splits; it is written to the shared folder.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = stored(pairs.distinct(), "links")
    before = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        large = meet(both, least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = stored(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = meet(large, least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        pairs = stored(small.union(least).distinct(), "links")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())
