"""Network analytics.

Each operator has a ``direction``: 'out' counts a friendship once, from its
``user_id`` end; 'both' counts it from either end.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.expressions import age_gap_label, age_gap_rank
from kinweave.graph import Graph
from kinweave.operators.edges import adjacency, degrees, neighbours
from kinweave.schemas import YEAR


def _check(direction: str) -> bool:
    if direction not in ("out", "both"):
        raise ValueError(f"direction must be 'out' or 'both', not {direction!r}")
    return direction == "both"


def cohort_analysis(graph: Graph, direction: str = "out") -> DataFrame:
    """Users and friendships by registration year and month, in the registration year.

    Friendships are first counted per user, year and month on the map side, so a hub
    enters the join as a few rows and the distinct users are plain row counts.
    """
    if _check(direction):
        ends = adjacency(graph.edges).select(F.col("src").alias("user_id"), "since")
    else:
        ends = graph.edges.select("user_id", "since")
    per_user = ends.groupBy(
        "user_id",
        F.year("since").alias("cohort_year"),
        F.month("since").alias("friendship_month"),
    ).agg(F.count(F.lit(1)).alias("n"))
    registered = graph.users.select(
        "user_id", F.year("registration_date").alias("cohort_year")
    )
    return (
        per_user.join(registered, ["user_id", "cohort_year"])
        .groupBy("cohort_year", "friendship_month")
        .agg(
            F.count(F.lit(1)).alias("users_count"),
            F.sum("n").alias("friendships_count"),
        )
        .orderBy("cohort_year", "friendship_month")
    )


def _ends(graph: Graph, attribute: str) -> DataFrame:
    """Each edge with one attribute of both its users as (first, second)."""
    first = graph.users.select(F.col("user_id"), F.col(attribute).alias("first"))
    second = graph.users.select(
        F.col("user_id").alias("friend_id"), F.col(attribute).alias("second")
    )
    # Rows without the attribute cannot contribute, so they leave before the joins.
    return (
        graph.edges.select("user_id", "friend_id")
        .join(first.where(F.col("first").isNotNull()), "user_id")
        .join(second.where(F.col("second").isNotNull()), "friend_id")
    )


def social_cities(graph: Graph, direction: str = "out", k: int = 5) -> DataFrame:
    """The k cities with most friendships to other cities, ties by name.

    Edges are first counted per pair of cities on the map side; the other direction
    and the number of partner cities come from those few rows.
    """
    both = _check(direction)
    pairs = (
        _ends(graph, "city")
        .where(F.col("first") != F.col("second"))
        .groupBy("first", "second")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if both:
        forth = F.struct(F.col("first").alias("city"), F.col("second").alias("partner"), "n")
        back = F.struct(F.col("second").alias("city"), F.col("first").alias("partner"), "n")
        sides = pairs.select(F.inline(F.array(forth, back)))
    else:
        sides = pairs.select(F.col("first").alias("city"), F.col("second").alias("partner"), "n")
    return (
        sides.groupBy("city", "partner")
        .agg(F.sum("n").alias("n"))
        .groupBy("city")
        .agg(
            F.sum("n").alias("connections_count"),
            F.count(F.lit(1)).alias("unique_cities"),
        )
        .orderBy(F.desc("connections_count"), "city")
        .limit(k)
    )


def age_gap_analysis(graph: Graph, direction: str = "out") -> DataFrame:
    """Friendships by difference of ages, in bucket order.

    The difference is the same from either end, so 'both' counts each edge twice.
    """
    weight = 2 if _check(direction) else 1
    rank = age_gap_rank(F.abs(F.col("first") - F.col("second")))
    return (
        _ends(graph, "age")
        .groupBy(rank.alias("rank"))
        .agg((F.count(F.lit(1)) * weight).alias("count"))
        .orderBy("rank")
        .select(age_gap_label(F.col("rank")).alias("age_category"), "count")
    )


def network_growth(
    graph: Graph,
    direction: str = "out",
    as_of: dt.date | None = None,
    months: int = 12,
) -> DataFrame:
    """New friendships per month: the first ``months`` months of the last two years.

    'out' starts two years before ``as_of`` to the day; 'both' starts with the
    calendar year two before and counts either end. Without ``as_of`` the newest
    date of the data is taken, from per-day counts of the same pass. Edges stored by year
    (``tabular.write_edges_by_year``) and an ``as_of`` read the folders of their years only.
    """
    both = _check(direction)
    dated = graph.edges.where(F.col("since").isNotNull())

    def recent(df: DataFrame, today) -> DataFrame:
        if both:
            return df.where(F.col("since") >= F.trunc(F.add_months(today, -24), "year"))
        return df.where(F.col("since") >= F.add_months(today, -24))

    if as_of is not None:
        dated = recent(dated, F.lit(as_of))
        if YEAR in dated.columns:
            dated = dated.where(F.col(YEAR) >= F.year(F.add_months(F.lit(as_of), -24)))
    by_day = dated.groupBy("since").agg(F.count(F.lit(1)).alias("n"))
    if as_of is None:
        by_day = recent(by_day, by_day.agg(F.max("since")).scalar())
    return (
        by_day.groupBy(F.year("since").alias("year"), F.month("since").alias("month"))
        .agg((F.sum("n") * (2 if both else 1)).alias("new_friendships"))
        .orderBy("year", "month")
        .limit(months)
    )


def age_clustering(graph: Graph, direction: str = "out") -> DataFrame:
    """Per decade of age the mean of (degree - 1) / degree.

    This is the estimate the workload defines, no true clustering coefficient. 'out'
    uses the out-degree, lets users of degree below 2 count as 0 and needs two users
    per group; 'both' uses the full degree and leaves such users out. Degrees are
    aggregated before they meet the users, so hubs are no hot join keys.
    """
    both = _check(direction)
    aged = graph.users.where(F.col("age").isNotNull()).select(
        "user_id", (F.floor(F.col("age") / 10) * 10).cast("int").alias("age_group")
    )
    deg = degrees(neighbours(graph.edges, direction)).withColumnRenamed("node", "user_id")
    if both:
        stats = aged.join(deg.where(F.col("degree") >= 2), "user_id")
        estimate = (F.col("degree") - 1) / F.col("degree")
    else:
        stats = aged.join(deg, "user_id", "left")
        estimate = F.when(
            F.col("degree") >= 2, (F.col("degree") - 1) / F.col("degree")
        ).otherwise(0.0)
    grouped = stats.groupBy("age_group").agg(
        F.count(F.lit(1)).alias("users_count"), F.avg(estimate).alias("clustering_estimate")
    )
    if not both:
        grouped = grouped.where(F.col("users_count") >= 2)
    return grouped.orderBy("age_group")
