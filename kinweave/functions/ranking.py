"""Positions and n-th rows that do not put one whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(
    df: DataFrame, keys: Sequence[str], order: str, alias: str = "position", width: int = 100_000
) -> DataFrame:
    """Add the 1-based position of each row in its group, by an integer column.

    Same values as ``row_number`` over the whole group for unique ``order`` values.
    Each group is cut into ranges of ``width`` order values; rows are numbered inside
    a range and shifted by the row count of the ranges before it, so a task sorts at
    most ``width`` rows and the running sum only sees one row per range.
    """
    keys = list(keys)
    cut = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)).cast("long"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cut.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    return (
        cut.withColumn("_row", F.row_number().over(inside))
        .alias("cut")
        .join(shifts.alias("shifts"), _same(["_range", *keys]))
        .select("cut.*", "shifts._shift")
        .withColumn(alias, F.col("_row") + F.col("_shift"))
        .drop("_range", "_row", "_shift")
    )


def _same(columns: Sequence[str]) -> Column:
    """Equal in all columns; nulls are equal to each other."""
    return reduce(Column.__and__, [F.col(f"cut.{c}").eqNullSafe(F.col(f"shifts.{c}")) for c in columns])


def nth_row(df: DataFrame, key: str, n: int, width: int = 10_000) -> DataFrame:
    """One row (n_rows, key): the row count and the n-th smallest key, counting from 0.

    Null keys count as rows but have no place; beyond the last key the answer is null.
    Up to 99 quantiles cut the keys; exact counts at and between the cuts name the part
    that holds the n-th key, and that part is cut again until it has at most ``width``
    rows. A cut is a part of its own, so a very frequent key is found at once.
    """
    value, total = F.col(key), df.count()
    rest = df.select(key).where(value.isNotNull())
    skip, left = n, rest.count()
    if not 0 <= n < left:
        rest, left = rest.limit(0), 0
    while left > width:
        cuts = sorted(set(rest.agg(F.percentile_approx(key, [i / 100 for i in range(1, 100)], 1_000)).first()[0]))
        edges = F.array(*[F.lit(cut) for cut in cuts])
        part = 2 * F.size(F.filter(edges, lambda edge: edge < value)) + F.array_contains(edges, value).cast("int")
        counts = sorted(rest.groupBy(part.alias("part")).count().collect())
        for number, rows in counts:
            if skip < rows:
                break
            skip -= rows
        below, exact = divmod(number, 2)
        if exact:
            rest = rest.where(value == cuts[below]).limit(1)
            skip, left = 0, 1
            continue
        left = rows
        if below:
            rest = rest.where(value > cuts[below - 1])
        if below < len(cuts):
            rest = rest.where(value < cuts[below])
    one = rest.orderBy(key).offset(skip).limit(1)
    return one.agg(F.max(key).alias(key)).select(F.lit(total).cast("long").alias("n_rows"), key)
