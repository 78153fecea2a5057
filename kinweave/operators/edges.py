"""Edge preparation: canonical form, adjacency, degrees, resolution against users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_edges(raw: DataFrame) -> DataFrame:
    """One row (smaller id, larger id, first date) per undirected friendship.

    Self-loops and rows with a missing end go away. Repeated pairs are combined on
    the map side before the shuffle, so a pair repeated very often is no hot key.
    """
    return (
        raw.where(F.col("user_id") != F.col("friend_id"))
        .groupBy(
            F.least("user_id", "friend_id").alias("user_id"),
            F.greatest("user_id", "friend_id").alias("friend_id"),
        )
        .agg(F.min("since").alias("since"))
    )


def is_canonical(edges: DataFrame) -> DataFrame:
    """One row: do all edges have user_id < friend_id (true for an empty table)?

    An edge with a missing end is not canonical.
    """
    ordered = F.coalesce(F.col("user_id") < F.col("friend_id"), F.lit(False))
    return edges.agg(F.coalesce(F.bool_and(ordered), F.lit(True)).alias("is_canonical"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge with its date, from a single pass over the edges."""
    forward = F.struct(
        F.col("user_id").alias("src"), F.col("friend_id").alias("dst"), F.col("since")
    )
    backward = F.struct(
        F.col("friend_id").alias("src"), F.col("user_id").alias("dst"), F.col("since")
    )
    return edges.select(F.inline(F.array(forward, backward)))


def neighbours(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(src, dst) without the date: 'both' ends, 'out' as stored, 'in' reversed."""
    out = edges.select(F.col("user_id").alias("src"), F.col("friend_id").alias("dst"))
    if direction == "out":
        return out
    if direction == "in":
        return out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction != "both":
        raise ValueError(f"direction must be 'out', 'in' or 'both', not {direction!r}")
    return edges.select(
        F.inline(
            F.array(
                F.struct(F.col("user_id").alias("src"), F.col("friend_id").alias("dst")),
                F.struct(F.col("friend_id").alias("src"), F.col("user_id").alias("dst")),
            )
        )
    )


def degrees(neighbour_rows: DataFrame) -> DataFrame:
    """(node, degree); partial counts per task keep hubs from becoming hot keys."""
    return neighbour_rows.groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("degree")
    )


def resolved_edges(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Edges whose two ends are both users."""
    known = users.select("user_id")
    return edges.join(known, "user_id", "left_semi").join(
        known.withColumnRenamed("user_id", "friend_id"), "friend_id", "left_semi"
    ).select(*edges.columns)
