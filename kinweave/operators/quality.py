"""Audit of loaded tables against the constraints of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _missing(*columns: str):
    condition = F.col(columns[0]).isNull()
    for column in columns[1:]:
        condition = condition | F.col(column).isNull()
    return condition


def integrity_report(users: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, n_violations), one row per check, zero when it holds.

    Duplicates are counted as repeated keys, all else as offending rows. Readers in
    permissive mode turn malformed ids and dates into nulls, which are counted as
    missing required fields.
    """

    def check(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n_violations"))

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return counts.where(F.col("n") > 1).agg(F.count(F.lit(1)).alias("n"))

    row_checks = edges.agg(
        F.count_if(F.col("user_id") == F.col("friend_id")).alias("self_loop"),
        F.count_if(_missing("user_id", "friend_id", "since")).alias("missing_friendship_field"),
    )
    user_checks = users.agg(
        F.count_if(_missing("user_id", "name", "registration_date")).alias("missing_user_field")
    )

    def unpivoted(df: DataFrame) -> DataFrame:
        rows = [
            F.struct(F.lit(c).alias("check"), F.col(c).alias("n_violations")) for c in df.columns
        ]
        return df.select(F.inline(F.array(*rows)))

    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.lit("user").alias("end"), F.col("user_id").alias("id")),
                F.struct(F.lit("friend").alias("end"), F.col("friend_id").alias("id")),
            )
        )
    ).where(F.col("id").isNotNull())
    # Counting ends per id first means a missing hub is one row in the anti join.
    per_id = ends.groupBy("id").agg(
        F.count_if(F.col("end") == "user").alias("dangling_user_id"),
        F.count_if(F.col("end") == "friend").alias("dangling_friend_id"),
    )
    known = users.select(F.col("user_id").alias("id"))
    dangling = per_id.join(known, "id", "left_anti").agg(
        F.coalesce(F.sum("dangling_user_id"), F.lit(0)).alias("dangling_user_id"),
        F.coalesce(F.sum("dangling_friend_id"), F.lit(0)).alias("dangling_friend_id"),
    )
    return (
        check("duplicate_user_id", repeated(users.select("user_id"), "user_id"))
        .unionByName(check("duplicate_pair", repeated(edges, "user_id", "friend_id")))
        .unionByName(unpivoted(row_checks))
        .unionByName(unpivoted(user_checks))
        .unionByName(unpivoted(dangling))
    )


#: Why a friendship is refused, in the order in which the constraints are tested.
MISSING_FIELD, SELF_LOOP, UNKNOWN_USER, UNKNOWN_FRIEND, DUPLICATE_PAIR = (
    "missing_field", "self_loop", "unknown_user", "unknown_friend", "duplicate_pair",
)


def checked_edges(users: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, friend_id, since, reason, n_rows): equal rows together, with the first constraint they break.

    ``reason`` is null for rows that a strict load accepts. Of the rows of one pair (in
    the same order of ends) the one with the earliest date is accepted and all others are
    duplicates. Equal rows are counted on the map side and ids that no user has are found
    once per id, so neither a pair repeated very often nor a missing hub is a hot key.
    """
    row = ["user_id", "friend_id", "since"]
    counted = edges.groupBy(*row).agg(F.count(F.lit(1)).alias("n"))
    ends = F.explode(F.array("user_id", "friend_id")).alias("id")
    known = users.select(F.col("user_id").alias("id"))
    unknown = counted.select(ends).where(F.col("id").isNotNull()).distinct().join(known, "id", "left_anti")
    for end in ("user_id", "friend_id"):
        missing = unknown.select(F.col("id").alias(end), F.lit(True).alias(f"no_{end}"))
        counted = counted.join(missing, end, "left")
    broken = (
        F.when(_missing(*row), MISSING_FIELD)
        .when(F.col("user_id") == F.col("friend_id"), SELF_LOOP)
        .when(F.col("no_user_id"), UNKNOWN_USER)
        .when(F.col("no_friend_id"), UNKNOWN_FRIEND)
    )
    counted = counted.select(*row, "n", broken.alias("reason"))
    # The window holds the different dates of one pair only.
    dates = Window.partitionBy("user_id", "friend_id").orderBy("since")
    whole = counted.where(F.col("reason").isNull()).withColumn("place", F.row_number().over(dates))
    accepted = F.when(F.col("place") == 1, 1).otherwise(0)
    split = F.inline(
        F.array(
            F.struct(F.lit(None).cast("string").alias("reason"), accepted.cast("long").alias("n_rows")),
            F.struct(F.lit(DUPLICATE_PAIR).alias("reason"), (F.col("n") - accepted).alias("n_rows")),
        )
    )
    whole = whole.select(*row, split).where(F.col("n_rows") > 0)
    refused = counted.where(F.col("reason").isNotNull()).select(*row, "reason", F.col("n").alias("n_rows"))
    return whole.unionByName(refused)


def accepted_edges(users: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, friend_id, since): the rows a strict load accepts, one per pair."""
    return checked_edges(users, edges).where(F.col("reason").isNull()).select("user_id", "friend_id", "since")


def rejected_rows(users: DataFrame, edges: DataFrame) -> DataFrame:
    """(user_id, friend_id, since, reason, n_rows): the rows it refuses, equal ones counted."""
    return checked_edges(users, edges).where(F.col("reason").isNotNull())
