"""A stored adjacency: neighbour lists in bucketed tables, so that no call shuffles them again.

``store_lists`` writes two tables of the session's catalog: ``<table>_counts`` (src, lists,
degree), bucketed by src, and ``<table>_lists`` (src, list, high, dsts), bucketed by (src, list). A hub's
lists lie in as many buckets as any other lists, so no bucket grows with a degree. A
question shuffles only its own seeds to the buckets, and reads the lists in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.graph import Graph
from kinweave.operators import neighbourhood as near


@dataclass(frozen=True)
class StoredLists:
    """``counts`` (src, lists, degree) and ``lists`` (src, list, high, dsts), both read from bucketed tables."""

    counts: DataFrame
    lists: DataFrame


def _write(df: DataFrame, table: str, folder: str, buckets: int, *keys: str) -> None:
    # Dealt by the buckets' own hash, so that each bucket is one sorted file.
    dealt = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    dealt.option("path", f"{folder}/{table}").format("parquet").saveAsTable(table)


def store_lists(graph: Graph, table: str, folder: str, buckets: int | None = None, chunk: int = near.CHUNK) -> StoredLists:
    """Write the graph's neighbour lists below ``folder``, replacing tables of that name.

    ``buckets`` is by default the number of shuffle partitions. With fewer, Spark may
    prefer to shuffle the lists instead of the question.
    """
    spark = graph.edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _write(near.list_counts(graph.adj, chunk), f"{table}_counts", folder, buckets, "src")
    counts = spark.table(f"{table}_counts")
    _write(near.chunks(graph.adj, counts), f"{table}_lists", folder, buckets, "src", "list")
    return read_lists(spark, table)


def read_lists(spark: SparkSession, table: str) -> StoredLists:
    return StoredLists(spark.table(f"{table}_counts"), spark.table(f"{table}_lists"))


def drop_lists(spark: SparkSession, table: str) -> None:
    """Remove both tables from the catalog; their files stay in their folder."""
    for part in ("counts", "lists"):
        spark.sql(f"DROP TABLE IF EXISTS `{table}_{part}`")


def _friends(stored: StoredLists, seeds: DataFrame) -> DataFrame:
    asked = near.distinct_seeds(seeds).withColumn("src", F.col("seed"))
    return near.meet(asked, stored.counts, stored.lists).select("seed", F.col("dst").alias("friend_id"))


def simple_friends(stored: StoredLists, seeds: DataFrame) -> DataFrame:
    """(seed, friend_id): direct friends of each seed."""
    return _friends(stored, seeds)


def friends_of_friends(stored: StoredLists, seeds: DataFrame) -> DataFrame:
    """(seed, fof): users two steps away that are neither the seed nor a direct friend."""
    friends = _friends(stored, seeds)
    return near.unmet(near.gathered_walks(friends, stored.counts, stored.lists))
