"""Graph and measurement tables derived from the supplied Parquet tables.

Customers of consecutive orders are friends; events are timed runs of five queries
on two engines over five dataset sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.graph import Graph

A, B = "a", "b"

# Size label and user count by size index.
SIZES = (
    ("super-tiny", 5_000),
    ("tiny", 10_000),
    ("very-small", 20_000),
    ("small", 50_000),
    ("x-large", 500_000),
)

# Events per source file, which is one trial of each size and profile.
FILE_EVENTS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_pairs(spark: SparkSession, sf_dir: str, gap: int) -> DataFrame:
    """(k, user_id, friend_id, since): customers of orders k and k + gap."""
    orders = table(spark, sf_dir, "orders")
    first = orders.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("user_id"),
        F.to_date("o_orderdate").alias("since"),
    )
    second = orders.select(
        (F.col("o_orderkey") - gap).alias("k"), F.col("o_custkey").alias("friend_id")
    )
    return first.join(second, "k").select("k", "user_id", "friend_id", "since")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not canonical: self-loops, reversed and repeated pairs."""
    return order_pairs(spark, sf_dir, 1).drop("k")


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like ``raw_edges``, with every hundredth second end unknown."""
    away = F.when(F.col("k") % 100 == 1, 1_000_000).otherwise(0)
    return order_pairs(spark, sf_dir, 1).select(
        "user_id", (F.col("friend_id") + away).alias("friend_id"), "since"
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    joined = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        key.alias("user_id"),
        F.col("c_name").alias("name"),
        F.when(key % 50 != 49, (18 + (key * 7) % 52).cast("int")).alias("age"),
        F.col("n_name").alias("city"),
        F.make_date(
            (1995 + key % 6).cast("int"),
            (1 + F.floor(key / 6) % 12).cast("int"),
            (1 + F.floor(key / 72) % 27).cast("int"),
        ).alias("registration_date"),
    )


def users_by_age(users: DataFrame) -> DataFrame:
    """Ages of all users: few different values, some of them missing."""
    return users.select("age")


def load_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_raw(users(spark, sf_dir), raw_edges(spark, sf_dir))


def skewed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_edges`` and two users who are friends with a large part of all others."""
    items = table(spark, sf_dir, "lineitem").where("l_linenumber = 7 AND l_quantity < 10")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    hubs = items.join(orders, "l_orderkey").select(
        F.col("o_custkey").alias("user_id"),
        (F.col("l_suppkey") % 2 + 1).alias("friend_id"),
        F.to_date("o_orderdate").alias("since"),
    )
    return raw_edges(spark, sf_dir).unionByName(hubs)


def load_skewed_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_raw(users(spark, sf_dir), skewed_edges(spark, sf_dir))


def skewed_pairs(spark: SparkSession, sf_dir: str, gap: int) -> DataFrame:
    """``pairs``, and every user beside each of the two hubs."""
    ids = users(spark, sf_dir).select(F.col("user_id").alias("user_b"))
    hubs = ids.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("user_a"), "user_b")
    return pairs(spark, sf_dir, gap).unionByName(hubs.where("user_a <> user_b")).distinct()


def pairs(spark: SparkSession, sf_dir: str, gap: int) -> DataFrame:
    """All pairs of different customers ``gap`` orders apart."""
    both = order_pairs(spark, sf_dir, gap).where(F.col("user_id") != F.col("friend_id"))
    return both.select(
        F.col("user_id").alias("user_a"), F.col("friend_id").alias("user_b")
    ).distinct()


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timed run per event, in seconds; the slower growth of engine b wins at large sizes."""
    event, size = F.col("event_id"), F.col("event_id") % 5
    on_a = F.col("user_id") % 2 == 0
    labels = F.array(*[F.lit(label) for label, _ in SIZES])
    counts = F.array(*[F.lit(n).cast("long") for _, n in SIZES])
    nth = (size + 1).cast("int")
    iteration = (1 + F.floor(event / 5) % 3).cast("int")
    return table(spark, sf_dir, "events").select(
        F.when(on_a, A).otherwise(B).alias("engine"),
        F.col("event_type").alias("query"),
        size.cast("int").alias("size_idx"),
        F.element_at(labels, nth).alias("size"),
        F.element_at(counts, nth).alias("users_n"),
        iteration.alias("iteration"),
        event.alias("run_no"),
        F.floor(event / FILE_EVENTS).alias("source"),
        F.concat(F.lit("p"), iteration.cast("string")).alias("profile"),
        F.col("user_id").cast("int").alias("results_count"),
        (
            F.col("value")
            * F.when(on_a, F.pow(F.lit(4.0), size)).otherwise(8 * F.pow(F.lit(2.0), size))
        ).alias("t"),
    )
