"""Statistics over measurement tables and ratios between two engines.

A measurement row has ``engine, query, iteration, t`` (seconds) and any further
columns named in ``keys``, which split the table into separate experiments. Engine
names are data: ``a`` is the first engine, ``b`` the second, and a ratio is
time of a / time of b, so above 1 engine b was faster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.expressions import CLEAR, UNCLEAR, rounded

WARMUP_ITERATIONS = 2
DEGRADATION_FACTOR = 4


def run_stats(
    runs: DataFrame, keys: Sequence[str] = (), newest_by: str | None = None
) -> DataFrame:
    """Per engine and query: n, min, max, mean, sample deviation of t.

    The deviation is 0 for a single measurement; all is null without any. With
    ``newest_by`` the row count of the newest measurement is kept as well.
    """
    n = F.count("t")
    stats = [
        n.alias("n_runs"),
        F.min("t").alias("min_time"),
        F.max("t").alias("max_time"),
        F.avg("t").alias("avg_time"),
        F.coalesce(F.stddev_samp("t"), F.when(n == 1, 0.0)).alias("std_time"),
    ]
    if newest_by is not None:
        stats.append(F.max_by("results_count", newest_by).alias("results_count"))
    return runs.groupBy(*keys, "engine", "query").agg(*stats)


def run_stats_warm(
    runs: DataFrame, keys: Sequence[str] = (), warmup: int = WARMUP_ITERATIONS
) -> DataFrame:
    """``run_stats`` without the first ``warmup`` iterations.

    Iterations are numbered from 1 in the data, so this is a filter the scan can use.
    """
    return run_stats(runs.where(F.col("iteration") > warmup), keys)


def dataset_means(
    runs: DataFrame, source: str, size: str = "size", users: str = "users_n"
) -> DataFrame:
    """(size, users_n, engine, query, mean_time): mean of the means per source file."""
    per_source = runs.groupBy(size, users, "engine", "query", source).agg(
        F.avg("t").alias("avg_time")
    )
    return per_source.groupBy(size, users, "engine", "query").agg(
        F.avg("avg_time").alias("mean_time")
    )


def run_counts(
    runs: DataFrame, engines: Sequence[str], source: str, size: str = "size"
) -> DataFrame:
    """Per size and engine the number of (source file, query) results with a mean."""
    results = runs.where(F.col("t").isNotNull()).select(size, "engine", "query", source).distinct()
    counted = results.groupBy(size).pivot("engine", list(engines)).count()
    return counted.na.fill(0, list(engines))


def _of(engine: str, value: str) -> Column:
    return F.max(F.when(F.col("engine") == engine, F.col(value)))


def efficiency(stats: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per query measured on both engines: ratio, improvement, times, significance.

    Takes the output of ``run_stats``. The gap is significant when it exceeds the sum
    of both deviations.
    """
    with_counts = "results_count" in stats.columns
    counts = ["results_count"] if with_counts else []
    sides = stats.groupBy(*keys, "query").agg(
        *[
            _of(engine, value).alias(f"{side}_{value}")
            for side, engine in (("a", a), ("b", b))
            for value in ["avg_time", "std_time", *counts]
        ]
    )
    both = sides.where((F.col("a_avg_time") > 0) & (F.col("b_avg_time") > 0))
    a_avg, b_avg = F.col("a_avg_time"), F.col("b_avg_time")
    deviations = F.coalesce("a_std_time", F.lit(0.0)) + F.coalesce("b_std_time", F.lit(0.0))
    return both.select(
        *keys,
        "query",
        F.round(a_avg / b_avg, 2).alias("efficiency_coefficient"),
        F.round(a_avg / b_avg, 1).alias("b_faster_times"),
        F.round((a_avg - b_avg) / a_avg * 100, 1).alias("improvement_percentage"),
        F.round(a_avg * 1000, 2).alias("a_time_ms"),
        F.round(b_avg * 1000, 2).alias("b_time_ms"),
        F.when(F.abs(a_avg - b_avg) > deviations, CLEAR).otherwise(UNCLEAR).alias("significance"),
        *(
            [
                F.coalesce(f"{side}_results_count", F.lit(0)).alias(f"result_count_{side}")
                for side in "ab"
            ]
            if with_counts
            else []
        ),
    )


def efficiency_summary(
    ratios: DataFrame, a: str, b: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean, median, extremes of the rounded ratios, wins per engine, winner.

    Equal ratios are merged first, so the exact median works on distinct values.
    """
    ratio = F.col("efficiency_coefficient")
    merged = ratios.groupBy(*keys, "efficiency_coefficient").agg(F.count(F.lit(1)).alias("n"))
    summed = merged.groupBy(*keys).agg(
        (F.sum(ratio * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("efficiency_coefficient", 0.5, F.col("n")).alias("median"),
        F.max(ratio).alias("highest"),
        F.min(ratio).alias("lowest"),
        F.sum(F.when(ratio > 1, F.col("n")).otherwise(0)).alias("b_wins_count"),
        F.sum(F.when(ratio < 1, F.col("n")).otherwise(0)).alias("a_wins_count"),
        F.sum("n").alias("total_comparisons"),
    ).where(F.col("total_comparisons") > 0)
    # Ratios have two decimals, so a mean of fewer than ten million is a tie or farther
    # from one than this takes out.
    mean = F.round("mean", 9)
    return summed.select(
        *keys,
        rounded("mean", 2).alias("average_efficiency"),
        rounded("median", 2).alias("median_efficiency"),
        rounded("highest", 2).alias("max_efficiency"),
        rounded("lowest", 2).alias("min_efficiency"),
        "a_wins_count",
        "b_wins_count",
        "total_comparisons",
        F.when(mean > 1, b).otherwise(a).alias("overall_winner"),
        F.concat(
            F.format_string("%.1f", rounded(F.abs(mean - 1) * 100, 1)), F.lit("%")
        ).alias("performance_advantage"),
    )


def efficiency_by_class(
    ratios: DataFrame, classes: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean ratio, comparisons and wins of engine b per class of queries."""
    ratio = F.col("efficiency_coefficient")
    return (
        ratios.join(classes, "query")
        .groupBy(*keys, "class")
        .agg(
            F.avg(ratio).alias("avg_efficiency"),
            F.sum(F.when(ratio > 1, 1).otherwise(0)).alias("b_wins_count"),
            F.count(F.lit(1)).alias("total_comparisons"),
        )
    )


def fastest_queries(ratios: DataFrame, a: str, b: str, k: int = 5) -> DataFrame:
    """The k queries with the highest ratio, ties by name, and how they read.

    ``times`` says how many times faster the faster engine was.
    """
    ratio = F.col("efficiency_coefficient")
    times = F.when(ratio > 1, F.round(ratio, 1)).when(
        ratio > 0, F.round(1 / F.greatest(ratio, F.lit(0.01)), 1)
    )
    faster = F.when(ratio > 1, b).when(ratio > 0, a)
    return (
        ratios.orderBy(ratio.desc(), "query")
        .limit(k)
        .select("query", ratio, faster.alias("faster"), times.alias("times"))
    )


def engine_ratio(stats: DataFrame, a: str, b: str) -> DataFrame:
    """Per query of engine a: pooled mean times in ms and their ratio, null if undefined."""
    left = stats.where(F.col("engine") == a).select(
        "query", (F.col("avg_time") * 1000).alias("a_ms")
    )
    right = stats.where(F.col("engine") == b).select(
        "query", (F.col("avg_time") * 1000).alias("b_ms")
    )
    return left.join(right, "query", "left").select(
        "query",
        F.round("a_ms", 2).alias("a_ms"),
        F.round("b_ms", 2).alias("b_ms"),
        F.round(F.try_divide("a_ms", "b_ms"), 2).alias("ratio"),
    )


def points(means: DataFrame, a: str, b: str, users: str = "users_n") -> DataFrame:
    """(query, users_n, a, b): finite mean times of sizes measured on both engines."""
    sides = means.groupBy("query", users).agg(
        F.avg(F.when(F.col("engine") == a, F.col("mean_time"))).alias("a"),
        F.avg(F.when(F.col("engine") == b, F.col("mean_time"))).alias("b"),
    )
    limit = F.lit(float("inf"))  # NaN is larger in Spark's order
    return sides.where((F.abs("a") < limit) & (F.abs("b") < limit))


def wins_by_size(size_points: DataFrame, a: str, b: str, users: str = "users_n") -> DataFrame:
    """(query, users_n, winner): the strictly faster engine of each size."""
    winner = F.when(F.col("a") < F.col("b"), a).when(F.col("b") < F.col("a"), b)
    return size_points.select("query", users, winner.alias("winner")).where(
        F.col("winner").isNotNull()
    )


def degradations(
    size_points: DataFrame,
    a: str,
    b: str,
    factor: float = DEGRADATION_FACTOR,
    users: str = "users_n",
) -> DataFrame:
    """(query, engine, users_n, growth): sizes where time grew ``factor``-fold or more.

    Works on means per size, so a window holds as many rows as there are sizes.
    """
    rows = size_points.select(
        "query",
        users,
        F.inline(
            F.array(
                F.struct(F.lit(a).alias("engine"), F.col("a").alias("t")),
                F.struct(F.lit(b).alias("engine"), F.col("b").alias("t")),
            )
        ),
    )
    order = Window.partitionBy("query", "engine").orderBy(users)
    growth = F.when(F.col("previous") > 0, F.try_divide("t", "previous"))
    return (
        rows.withColumn("previous", F.lag("t").over(order))
        .select("query", "engine", users, growth.alias("growth"))
        .where(F.col("growth") >= factor)
    )
