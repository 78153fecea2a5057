"""Monotone curves of time against size, and where the curves of two engines cross.

Input are points (query, users_n, a, b). A curve has one row per size; the dense
grid is generated from each segment's own row, without a join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DENSE = 2000
TOUCH = 1e-12


def _end_slope(h0: Column, h1: Column, s0: Column, s1: Column) -> Column:
    """One-sided three-point slope, limited to keep the curve's shape."""
    slope = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
    return (
        F.when(s1.isNull(), s0)
        .when(F.signum(slope) != F.signum(s0), 0.0)
        .when((F.signum(s0) != F.signum(s1)) & (F.abs(slope) > 3 * F.abs(s0)), 3 * s0)
        .otherwise(slope)
    )


def _inner_slope(h0: Column, h1: Column, s0: Column, s1: Column) -> Column:
    """Weighted harmonic mean of the secants on both sides, 0 at a turning point."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(s0 * s1 <= 0, 0.0).otherwise((w0 + w1) / (w0 / s0 + w1 / s1))


def segments(size_points: DataFrame) -> DataFrame:
    """One row per gap between neighbouring sizes with end values and slopes.

    Slopes follow Fritsch and Carlson's monotone cubic interpolation. Queries with
    fewer than two sizes have no segment.
    """
    by_size = Window.partitionBy("query").orderBy("users_n")
    whole = Window.partitionBy("query")
    x = F.col("users_n").cast("double")
    df = size_points.where(F.col("users_n") > 0).select(
        "query",
        x.alias("x"),
        "a",
        "b",
        F.lead(x).over(by_size).alias("x1"),
        F.min(x).over(whole).alias("x_min"),
        F.max(x).over(whole).alias("x_max"),
    )
    df = df.withColumn("h", F.col("x1") - F.col("x"))
    by_size = Window.partitionBy("query").orderBy("x")

    def at(column: str, shift: int) -> Column:
        return F.lag(column, -shift).over(by_size) if shift else F.col(column)

    for y in ("a", "b"):
        df = df.withColumn(f"s_{y}", (at(y, 1) - F.col(y)) / F.col("h"))
    df = df.select(
        "*",
        *[at("h", k).alias(f"h_{n}") for k, n in ((-2, "pp"), (-1, "p"), (1, "n"))],
        *[
            at(f"s_{y}", k).alias(f"s_{y}_{n}")
            for y in ("a", "b")
            for k, n in ((-2, "pp"), (-1, "p"), (1, "n"))
        ],
    )
    for y in ("a", "b"):
        s, sp, spp, sn = (F.col(f"s_{y}{n}") for n in ("", "_p", "_pp", "_n"))
        h, hp, hpp, hn = (F.col(f"h{n}") for n in ("", "_p", "_pp", "_n"))
        slope = (
            F.when(sp.isNull(), _end_slope(h, hn, s, sn))
            .when(s.isNull(), _end_slope(hp, hpp, sp, spp))
            .otherwise(_inner_slope(hp, h, sp, s))
        )
        df = df.withColumn(f"d_{y}", slope)
    ends = [at(c, 1).alias(f"{c}1") for c in ("a", "b", "d_a", "d_b")]
    return df.select("query", "x", "x1", "h", "x_min", "x_max", "a", "b", "d_a", "d_b", *ends).where(
        F.col("x1").isNotNull()
    )


def _cubic(y: str, u: Column) -> Column:
    """Hermite cubic on [0, 1] from the end values and slopes of a segment."""
    y0, y1 = F.col(y), F.col(f"{y}1")
    m0, m1 = F.col(f"d_{y}") * F.col("h"), F.col(f"d_{y}1") * F.col("h")
    rise = y1 - y0
    return y0 + u * (m0 + u * ((3 * rise - 2 * m0 - m1) + u * (m0 + m1 - 2 * rise)))


def pchip_curve(size_points: DataFrame, dense: int = DENSE) -> DataFrame:
    """(query, i, x, a, b): both curves at ``dense`` log-spaced sizes, i from 0."""
    low, high = F.log10("x_min"), F.log10("x_max")
    step = (high - low) / (dense - 1)

    def index_of(x: str) -> Column:
        return F.floor((F.log10(x) - low) / step).cast("int")

    first = F.when(F.col("x") == F.col("x_min"), 0).otherwise(index_of("x") - 1)
    last = F.when(F.col("x1") == F.col("x_max"), dense - 1).otherwise(index_of("x1") + 1)
    grid = segments(size_points).withColumn("i", F.explode(F.sequence(first, last)))
    # F.pow of the two ends may miss them by a rounding error, which the outer
    # segments take in by having no outer bound.
    placed = grid.withColumn("gx", F.pow(F.lit(10.0), low + F.col("i") * step)).where(
        ((F.col("gx") >= F.col("x")) | (F.col("x") == F.col("x_min")))
        & ((F.col("gx") < F.col("x1")) | (F.col("x1") == F.col("x_max")))
    )
    u = (F.col("gx") - F.col("x")) / F.col("h")
    return placed.select(
        "query", "i", F.col("gx").alias("x"), _cubic("a", u).alias("a"), _cubic("b", u).alias("b")
    )


def _with_roots(curve: DataFrame) -> DataFrame:
    """Add the difference ``d`` of the curves and the sizes ``roots`` where it changes sign.

    A root lies between a grid point and the next one, by a straight line, or on the
    point itself where the curves touch.
    """
    by_i = Window.partitionBy("query").orderBy("i")
    diff = F.col("a") - F.col("b")
    steps = curve.select(
        "query",
        "i",
        "x",
        diff.alias("d"),
        F.lead("x").over(by_i).alias("x1"),
        F.lead(diff).over(by_i).alias("d1"),
    )
    turns = F.signum("d") != F.signum("d1")
    root = F.col("x") - F.col("d") * (F.col("x1") - F.col("x")) / F.nullif(
        F.col("d1") - F.col("d"), F.lit(0.0)
    )
    middle = (F.col("x") + F.col("x1")) / 2
    candidates = F.array(
        F.when(turns, F.coalesce(root, middle)), F.when(F.abs("d") <= TOUCH, F.col("x"))
    )
    return steps.select("query", "i", "d", F.array_compact(candidates).alias("roots"))


def crossings(curve: DataFrame) -> DataFrame:
    """(query, x): every size where the order of the two curves changes, or they touch."""
    return _with_roots(curve).select("query", F.explode("roots").alias("x")).distinct()


def crossovers(curve: DataFrame, a: str, b: str) -> DataFrame:
    """Per query: number of crossings, the first one (critical size), first and last leader.

    One pass over the grid; the roots gathered per query are at most two per point.
    """

    def leader(d: Column) -> Column:
        return F.when(d < 0, a).when(d > 0, b).otherwise("equal")

    gathered = (
        _with_roots(curve)
        .groupBy("query")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("roots"))).alias("roots"),
            F.min_by("d", "i").alias("first"),
            F.max_by("d", "i").alias("last"),
        )
    )
    return gathered.select(
        "query",
        F.size("roots").cast("long").alias("n_crossings"),
        F.array_min("roots").alias("critical"),
        leader(F.col("first")).alias("initial"),
        leader(F.col("last")).alias("final"),
    )


def max_gap(curve: DataFrame, a: str, b: str) -> DataFrame:
    """Per query: largest gap in percent of the slower time, the faster engine, the size."""
    gap = F.try_divide(F.abs(F.col("a") - F.col("b")), F.greatest("a", "b")) * 100
    row = F.struct(
        gap.alias("gap"),
        (-F.col("i")).alias("earliest"),
        F.col("x"),
        F.when(F.col("a") < F.col("b"), a).otherwise(b).alias("winner"),
    )
    best = curve.groupBy("query").agg(F.max(F.when(gap.isNotNull(), row)).alias("best"))
    return best.select(
        "query",
        F.col("best.gap").alias("max_rel_pct"),
        F.col("best.winner").alias("winner_at_max"),
        F.col("best.x").alias("x_at_max"),
    )


def global_threshold(critical_sizes: DataFrame) -> DataFrame:
    """One row: the median of the queries' first crossings, cut to an integer."""
    known = critical_sizes.where(F.col("critical") > 0)
    return known.agg(F.floor(F.percentile("critical", 0.5)).cast("long").alias("global_threshold"))
