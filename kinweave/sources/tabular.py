"""Typed CSV ingestion and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave import schemas


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, mode: str = "PERMISSIVE"
) -> DataFrame:
    """A CSV with header under an explicit schema; empty fields are null.

    ``mode='FAILFAST'`` stops at a malformed row, as a strict bulk load does;
    ``'PERMISSIVE'`` loads it with nulls, which ``integrity_report`` counts.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "")
        .option("mode", mode)
        .csv(path)
    )


def ingest_users(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return read_csv(spark, path, schemas.USERS, mode)


def ingest_friendships(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return read_csv(spark, path, schemas.FRIENDSHIPS, mode)


#: Column for the text of a row that doesn't fit its schema.
UNREAD = "unread_row"


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV that fit the schema, and (file, unread_row, columns) of those that don't.

    A refused row has a field that can't be read as its type, or too few or too many
    fields; its readable fields stand beside its text.
    """
    marked = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema] + [T.StructField(UNREAD, T.StringType(), True)])
    rows = (
        spark.read.schema(marked)
        .option("header", True)
        .option("nullValue", "")
        .option("columnNameOfCorruptRecord", UNREAD)
        .csv(path)
        # Always true, but it needs each field: one that nobody asks for would go untested.
        .where(F.concat_ws("", *[F.col(name).cast("string") for name in schema.names]) >= "")
    )
    refused = rows.where(F.col(UNREAD).isNotNull())
    return rows.where(F.col(UNREAD).isNull()).select(*schema.names), refused.select(
        F.col("_metadata.file_path").alias("file"), UNREAD, *schema.names
    )


def write_csv(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """A folder of CSV files with header, at most ``rows_per_file`` rows each."""
    df.write.option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_tables(
    users: DataFrame,
    edges: DataFrame,
    folder: str,
    rows_per_file: int = 1_000_000,
    parts: int | None = None,
) -> None:
    """Users and friendships as CSV, and both as Parquet for the queries.

    Edges sorted by ``user_id`` inside range partitions let the scan of a point query
    skip row groups by their minimum and maximum. There are at least as many files as
    cores (or ``parts``), so that small tables are read in parallel as well.
    """
    spark = edges.sparkSession
    parts = parts or spark.sparkContext.defaultParallelism
    ordered = edges.repartitionByRange(parts, "user_id")
    for name, df in (
        ("users", users.repartition(parts)),
        ("friendships", ordered.sortWithinPartitions("user_id", "friend_id")),
    ):
        # The CSV is copied from the stored Parquet, so the input is computed once.
        write_parquet(df, f"{folder}/{name}.parquet")
        write_csv(spark.read.parquet(f"{folder}/{name}.parquet"), f"{folder}/{name}.csv", rows_per_file)


def write_edges_by_year(edges: DataFrame, folder: str, parts: int | None = None) -> None:
    """Friendships in folders by year of ``since``, so that a time range reads its years only.

    Rows are dealt by range of date and user: a file holds few years, a year that has most
    of the rows is written by many tasks, and dates within a file are sorted for its
    row groups' minima.
    """
    parts = parts or edges.sparkSession.sparkContext.defaultParallelism
    dealt = edges.withColumn(schemas.YEAR, F.year("since")).repartitionByRange(parts, "since", "user_id")
    dealt.sortWithinPartitions(schemas.YEAR, "since", "user_id").write.partitionBy(schemas.YEAR).parquet(folder)


def read_edges_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """The stored friendships with ``since_year``, which ``network_growth`` prunes by."""
    schema = T.StructType([*schemas.FRIENDSHIPS, T.StructField(schemas.YEAR, T.IntegerType(), True)])
    return spark.read.schema(schema).parquet(folder)
