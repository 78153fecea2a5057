"""Trends of mean ratios over a sequence of experiments, and decisions from them.

A history has one row per experiment with ``seq`` (its place, any increasing
integer), ``average_efficiency``, ``a_wins_count`` and ``b_wins_count``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.expressions import CLEAR, UNCLEAR, two_sided_p
from kinweave.functions.ranking import positions

# Fixed values of the trend labels: flat below, clear above, significance level.
FLAT, STEEP, LEVEL = 0.05, 0.1, 0.1


def _placed(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace ``seq`` by gapless places 0, 1, 2, ..."""
    known = history.where(F.col("average_efficiency").isNotNull())
    return positions(known, keys, "seq", alias="place").withColumn("place", F.col("place") - 1)


def _beside(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of their group; null keys are equal to each other."""
    found = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(found, same, how).drop(*[f"_{k}" for k in keys])


def _shape(y: Column) -> list[Column]:
    return [
        F.coalesce(F.try_divide(F.stddev_pop(y), F.avg(y)), F.lit(0.0)).alias("volatility"),
        F.min(y).alias("efficiency_min"),
        F.max(y).alias("efficiency_max"),
        F.max_by(y, "place").alias("current_efficiency"),
        F.count(F.lit(1)).alias("data_points"),
    ]


def trend_regression(
    history: DataFrame, a: str, b: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Least squares of mean efficiency against place, with labels and significance.

    The p-value is the two-sided one of the correlation. Two points always fit, so
    they are significant exactly when they differ; a flat line never is.
    """
    y, x = F.col("average_efficiency"), F.col("place").cast("double")
    fitted = _placed(history, keys).groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_r2(y, x).alias("r_squared"),
        *_shape(y),
        *[
            (F.max_by(f"{side}_wins_count", "place") > F.min_by(f"{side}_wins_count", "place"))
            .alias(f"{side}_up")
            for side in "ab"
        ],
    )
    enough = F.col("data_points") >= 2
    flat = F.col("efficiency_min") == F.col("efficiency_max")
    r2 = F.when(flat, 0.0).otherwise(F.least(F.col("r_squared"), F.lit(1.0)))
    freedom = F.col("data_points") - 2
    t = F.sqrt(F.try_divide(r2 * freedom, 1 - r2))
    p_value = (
        F.when(~enough, None)
        .when(flat, 1.0)
        .when((freedom == 0) | (r2 == 1), 0.0)
        .otherwise(two_sided_p(t, freedom))
    )
    slope = F.when(flat, 0.0).otherwise(F.col("slope"))
    trend = (
        F.when(~enough, "insufficient_data")
        .when(F.abs(slope) < FLAT, "stable")
        .when(slope > STEEP, f"{b}_improving")
        .when(slope > 0, f"{b}_slightly_improving")
        .when(slope < -STEEP, f"{a}_improving")
        .otherwise(f"{a}_slightly_improving")
    )
    shown = ["volatility", "efficiency_min", "efficiency_max", "current_efficiency"]
    return fitted.select(
        *keys,
        F.coalesce(p_value < LEVEL, F.lit(False)).alias("has_trend"),
        trend.alias("trend"),
        F.when(enough, slope).alias("slope"),
        F.when(enough, r2).alias("r_squared"),
        p_value.alias("p_value"),
        *[F.when(enough, F.col(c)).alias(c) for c in shown],
        *[
            F.when(enough, F.when(F.col(f"{side}_up"), "increasing").otherwise("decreasing")).alias(
                f"{side}_wins_trend"
            )
            for side in "ba"
        ],
        "data_points",
    )


def trend_halves(history: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """The simpler estimate: second-half mean minus first-half mean, per step of a half."""
    y = F.col("average_efficiency")
    placed = _placed(history, keys)
    sizes = placed.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    halved = _beside(placed, sizes, keys) if keys else placed.withColumn("half", sizes.scalar())
    early = F.col("place") < F.col("half")
    means = halved.groupBy(*keys).agg(
        F.avg(F.when(early, y)).alias("first_half"),
        F.avg(F.when(~early, y)).alias("second_half"),
        F.max("half").alias("half"),
        *_shape(y),
    )
    enough = F.col("data_points") >= 3
    slope = F.try_divide(F.col("second_half") - F.col("first_half"), F.col("half"))
    trend = (
        F.when(~enough, "insufficient_data")
        .when(slope > FLAT, f"{b}_improving")
        .when(slope < -FLAT, f"{a}_improving")
        .otherwise("stable")
    )
    shown = ["volatility", "efficiency_min", "efficiency_max", "current_efficiency"]
    return means.select(
        *keys,
        enough.alias("has_trend"),
        trend.alias("trend"),
        F.when(enough, slope).alias("slope"),
        *[F.when(enough, F.col(c)).alias(c) for c in shown],
        "data_points",
    )


def stop_rules(trends: DataFrame, size: str = "current_size") -> DataFrame:
    """Add ``should_stop`` and the number of the rule that says so (null: go on).

    Rules in order, with T = 0.1 for sizes named large and 0.15 otherwise:
    1 low and falling, 2 high and rising, 3a settled low, 3b settled high,
    4 steep and unsteady.
    """
    eff, slope, vol = F.col("current_efficiency"), F.col("slope"), F.col("volatility")
    limit = F.when(F.col(size).contains("large"), 0.1).otherwise(0.15)
    settled = (vol < 0.1) & (F.abs(slope) < limit)
    rule = (
        F.when(~F.col("has_trend"), None)
        .when((eff < 0.5) & (slope < -limit) & (vol < 0.2), "1")
        .when((eff > 2.0) & (slope > limit) & (vol < 0.2), "2")
        .when(settled & (eff < 0.7), "3a")
        .when(settled & (eff > 1.5), "3b")
        .when((F.abs(slope) > 0.3) & (vol > 0.3), "4")
    )
    return trends.withColumn("rule", rule).withColumn("should_stop", F.col("rule").isNotNull())


def run_budget(
    base_runs: DataFrame, ratios: DataFrame, previous_size: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Next number of runs per query, from the results of the previous size.

    ``base_runs`` has (keys, query, base_runs). ``ratios`` is the output of
    ``efficiency`` with ``size`` and ``seq``. A query's ratio, significance and change
    are those of the newest experiment of ``previous_size``; a query that is missing
    there has ratio 1, no clear difference and no change. Whether it rises and how much
    it varies comes from its three newest ratios of any size. Without results of the
    previous size the base applies.
    """
    by = [*keys, "query"]
    sized = ratios.where(F.col("size") == previous_size)
    newest_seq = sized.groupBy(*keys).agg(F.max("seq").alias("_newest"))
    at = _beside(sized, newest_seq, keys) if keys else sized.withColumn("_newest", newest_seq.scalar())
    last = (
        at.where(F.col("seq") == F.col("_newest"))
        .groupBy(*by)
        .agg(
            F.max("efficiency_coefficient").alias("eff"),
            F.max("significance").alias("significance"),
            F.max("improvement_percentage").alias("improvement"),
        )
    )
    newest = Window.partitionBy(*by).orderBy(F.desc("seq"))
    ratio = F.col("efficiency_coefficient")
    recent = ratios.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= 3)

    def of(age: int, column: str) -> Column:
        return F.max(F.when(F.col("age") == age, F.col(column)))

    facts = recent.groupBy(*by).agg(
        of(1, "efficiency_coefficient").alias("newest"),
        of(2, "efficiency_coefficient").alias("before"),
        F.when(
            F.count(F.lit(1)) >= 2, F.try_divide(F.stddev_pop(ratio), F.avg(ratio))
        ).alias("volatility"),
    )
    joined = base_runs.join(facts, by, "left").join(last, by, "left")
    if keys:
        known = sized.select(*keys).distinct().withColumn("has_history", F.lit(True))
        joined = joined.join(known, list(keys), "left")
    else:
        joined = joined.withColumn("has_history", F.lit(not sized.isEmpty()))
    eff = F.coalesce("eff", F.lit(1.0))
    clear = F.coalesce("significance", F.lit(UNCLEAR)) == CLEAR
    change = F.abs(F.coalesce("improvement", F.lit(0.0)))
    vol = F.coalesce("volatility", F.lit(0.0))
    rising = F.coalesce(F.col("newest") > F.col("before"), F.lit(False))
    base = F.col("base_runs")

    def at_least(n: int, runs: Column) -> Column:
        return F.greatest(F.lit(n), F.floor(runs).cast("int"))

    def at_most(n: int, runs: Column) -> Column:
        return F.least(F.lit(n), F.floor(runs).cast("int"))

    # Thresholds, factors and bounds of the seven rules, first match wins.
    rules = [
        ((eff < 0.3) & clear, at_least(2, base / 6)),
        (eff < 0.6, at_least(3, base / 3)),
        ((eff > 2.0) & clear, at_most(100, base * 2)),
        (eff > 1.3, at_most(80, base * 1.5)),
        ((change > 300) & (vol > 0.4), at_most(60, base * 1.3)),
        (rising & (eff > 0.8), at_most(70, base * 1.4)),
        ((vol < 0.2) & (change < 100), at_least(5, base * 0.8)),
    ]
    fresh = F.col("has_history").isNull() | ~F.col("has_history")
    rule, runs = F.when(fresh, 0), F.when(fresh, base.cast("int"))
    for number, (condition, value) in enumerate(rules, start=1):
        rule, runs = rule.when(condition, number), runs.when(condition, value)
    return joined.select(
        *by,
        base.cast("int").alias("base_runs"),
        rule.otherwise(0).alias("rule"),
        runs.otherwise(base.cast("int")).alias("new_runs"),
    )


def config_comparison(trials: DataFrame) -> DataFrame:
    """Per profile: sizes done, successful and failed trials, last ratio and winner.

    ``trials`` has (profile, size, seq, status, average_efficiency, overall_winner).
    The last values are those of the newest successful trial with a ratio; without
    one they are 1.0 and 'Unknown'.
    """
    done = F.col("status") == "completed"
    has_ratio = done & F.col("average_efficiency").isNotNull()
    place = F.when(has_ratio, F.col("seq"))
    sizes = trials.select("profile", "size").distinct().groupBy("profile").agg(
        F.count(F.lit(1)).alias("sizes_completed")
    )
    return (
        trials.groupBy("profile")
        .agg(
            F.count_if(done).alias("successful_iterations"),
            F.count_if(~done).alias("failed_iterations"),
            F.coalesce(F.max_by("average_efficiency", place), F.lit(1.0)).alias(
                "final_efficiency"
            ),
            F.coalesce(F.max_by("overall_winner", place), F.lit("Unknown")).alias("final_winner"),
        )
        .join(sizes, "profile")
        .select(
            "profile",
            "sizes_completed",
            "successful_iterations",
            "failed_iterations",
            "final_efficiency",
            "final_winner",
        )
    )


def size_summary(trials: DataFrame, keys: Sequence[str] = ("profile", "size")) -> DataFrame:
    """Per size: successful and all trials, mean, median, extremes of the mean ratio.

    Ratios are rounded values, so merging equal ones first bounds the median's input.
    """
    done = F.col("status") == "completed"
    ratio = F.when(done, F.coalesce("average_efficiency", F.lit(1.0)))
    merged = trials.groupBy(*keys, ratio.alias("ratio")).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("ratio").isNotNull(), F.col("n"))
    return merged.groupBy(*keys).agg(
        F.coalesce(F.sum(known), F.lit(0)).alias("successful"),
        F.sum("n").alias("total"),
        F.try_divide(F.sum(F.col("ratio") * known), F.sum(known)).alias("avg_efficiency"),
        F.percentile("ratio", 0.5, F.coalesce(known, F.lit(0))).alias("median_efficiency"),
        F.min("ratio").alias("min_efficiency"),
        F.max("ratio").alias("max_efficiency"),
    )
