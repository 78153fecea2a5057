"""Explicit schemas and the fixed tables of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("age", T.IntegerType(), True),
        T.StructField("city", T.StringType(), True),
        T.StructField("registration_date", T.DateType(), True),
    ]
)

FRIENDSHIPS = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("friend_id", T.LongType(), False),
        T.StructField("since", T.DateType(), True),
    ]
)

#: Partition column of friendships stored by the year of ``since``.
YEAR = "since_year"

# The engine names used as keys in result documents.
ENGINES = ("postgres", "neo4j")

# Query names by class.
GRAPH_QUERIES = (
    "simple_friends",
    "friends_of_friends",
    "mutual_friends",
    "friend_recommendations",
    "shortest_path",
)
ANALYTICAL_QUERIES = (
    "cohort_analysis",
    "social_cities",
    "age_gap_analysis",
    "network_growth",
    "age_clustering",
)

# Dataset sizes in ascending order with (users, mean friends, iterations).
SIZE_LADDER = {
    "super-tiny": (5_000, 5, 3),
    "tiny": (10_000, 22, 3),
    "very-small": (20_000, 500, 3),
    "small": (50_000, 20, 2),
    "medium": (100_000, 50, 2),
    "large": (250_000, 15, 1),
    "x-large": (500_000, 12, 1),
    "xx-large": (1_000_000, 100, 1),
}

# User counts assumed for a result file that does not state its own.
ASSUMED_USERS = {
    "super-tiny": 5_000,
    "tiny": 10_000,
    "very-small": 20_000,
    "small": 50_000,
    "medium": 500_000,
    "large": 2_000_000,
    "x-large": 5_000_000,
}


def size_ladder(spark: SparkSession) -> DataFrame:
    """The size ladder as a table (size, ordinal, users, avg_friends, iterations)."""
    rows = [(s, i, *spec) for i, (s, spec) in enumerate(SIZE_LADDER.items())]
    return spark.createDataFrame(
        rows, "size string, ordinal int, users long, avg_friends int, iterations int"
    )


def query_classes(spark: SparkSession) -> DataFrame:
    """(query, class) with class 'graph' or 'analytical'."""
    rows = [(q, "graph") for q in GRAPH_QUERIES] + [(q, "analytical") for q in ANALYTICAL_QUERIES]
    return spark.createDataFrame(rows, "query string, class string")
