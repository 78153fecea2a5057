"""Counts and degree metrics of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.ranking import nth_row
from kinweave.graph import Graph
from kinweave.operators.edges import degrees, neighbours


def _labelled(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of one-row (n) frames as (part, n)."""
    frames = [df.select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def _part(name: str) -> Column:
    return F.max(F.when(F.col("part") == name, F.col("n")))


def db_metrics_counts(graph: Graph) -> DataFrame:
    """One row: number of users and of friendships."""
    return _labelled({"users": _rows(graph.users), "edges": _rows(graph.edges)}).agg(
        _part("users").alias("users_count"), _part("edges").alias("friendships_count")
    )


def graph_metadata(graph: Graph) -> DataFrame:
    """One row: users, friendships and mean degree 2E/N."""
    return db_metrics_counts(graph).select(
        F.col("users_count").alias("num_users"),
        F.col("friendships_count").alias("num_friendships"),
        F.try_divide(2.0 * F.col("friendships_count"), F.col("users_count")).alias("avg_degree"),
    )


def db_metrics_degree_out(graph: Graph) -> DataFrame:
    """One row: distinct first ends, distinct second ends, mean row count per pair.

    The mean is 1.0 for canonical edges by definition, as in the workload.
    """
    pairs = _labelled(
        {
            "pairs": _rows(graph.edges.select("user_id", "friend_id").distinct()),
            "edges": _rows(graph.edges),
        }
    )
    ends = graph.edges.select(
        F.inline(
            F.array(
                F.struct(F.lit("first").alias("part"), F.col("user_id").alias("id")),
                F.struct(F.lit("second").alias("part"), F.col("friend_id").alias("id")),
            )
        )
    )
    counted = ends.distinct().groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(pairs).agg(
        F.coalesce(_part("first"), F.lit(0)).alias("users_with_friends"),
        F.coalesce(_part("second"), F.lit(0)).alias("unique_friends"),
        F.coalesce(F.try_divide(_part("edges"), _part("pairs")), F.lit(0.0)).alias(
            "avg_friends_per_user"
        ),
    )


def db_metrics_degree_both(graph: Graph) -> DataFrame:
    """One row: users with friends, mean, smallest and largest degree."""
    return degrees(neighbours(graph.edges)).agg(
        F.count(F.lit(1)).alias("users_with_friends"),
        F.avg("degree").alias("avg_degree"),
        F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"),
    )


def age_distribution(users: DataFrame) -> DataFrame:
    """One row: smallest, largest, mean and exact median age.

    Users are first counted per age, so the median works on as many rows as there
    are ages.
    """
    ages = users.where(F.col("age").isNotNull()).groupBy("age").agg(
        F.count(F.lit(1)).alias("n")
    )
    return ages.agg(
        F.min("age").alias("min_age"),
        F.max("age").alias("max_age"),
        F.try_divide(F.sum(F.col("age") * F.col("n")), F.sum("n")).alias("avg_age"),
        F.percentile("age", 0.5, F.col("n")).alias("median_age"),
    )


def graph_counts(graph: Graph) -> DataFrame:
    """(kind, name, n): rows per table, nodes and relationships in total and by type."""
    counted = _labelled({"users": _rows(graph.users), "friendships": _rows(graph.edges)})

    def kinds(table: str, total: str, kind: str, label: str) -> Column:
        rows = [("table", table), (total, "all"), (kind, label)]
        return F.array(
            *[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in rows]
        )

    names = F.when(
        F.col("part") == "users", kinds("users", "nodes_total", "nodes_by_label", "User")
    ).otherwise(
        kinds("friendships", "relationships_total", "relationships_by_type", "FRIENDS_WITH")
    )
    return counted.select(F.explode(names).alias("k"), "n").select("k.kind", "k.name", "n")


def pick_pair(graph: Graph) -> DataFrame:
    """One row (user_a, user_b): a user with friends, and a user who is no friend of theirs.

    Both are the first in the order of a hash of the id, which stands for a random
    order and repeats from run to run.
    """
    shuffled = F.md5(F.col("user_id").cast("string"))
    adj = graph.adj
    ids = graph.users.select("user_id")
    first = (
        ids.join(adj, ids.user_id == adj.src, "left_semi").orderBy(shuffled, "user_id").limit(1)
    )
    own = first.select(F.col("user_id").alias("id"))
    friends = adj.join(own, adj.src == own.id, "left_semi").select(F.col("dst").alias("id"))
    excluded = own.unionByName(friends)
    second = (
        ids.join(excluded, ids.user_id == excluded.id, "left_anti")
        .orderBy(shuffled, "user_id")
        .limit(1)
    )
    both = _labelled(
        {
            "a": first.select(F.col("user_id").alias("n")),
            "b": second.select(F.col("user_id").alias("n")),
        }
    )
    return both.agg(_part("a").alias("user_a"), _part("b").alias("user_b"))


def nth_candidate(candidates: DataFrame, key: str, n: int) -> DataFrame:
    """One row: how many candidates there are, and the n-th of them in key order."""
    return nth_row(candidates, key, n)
