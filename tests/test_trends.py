import statistics

import numpy as np
import pytest

from kinweave.operators import trends

HISTORY = "profile string, seq long, average_efficiency double, a_wins_count long, b_wins_count long"


def history(spark, **profiles):
    data = [
        (name, 10 * i, float(v), 5 - i, i)
        for name, values in profiles.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(data, HISTORY)


def by_profile(df):
    return {r.profile: r for r in df.collect()}


def test_regression_labels(spark):
    df = history(
        spark,
        up=[0.5, 0.7, 0.95, 1.1],
        slow=[1.0, 1.06, 1.13],
        down=[2.0, 1.7, 1.5],
        easy=[1.0, 0.93, 0.86],
        flat=[1.0, 1.0, 1.0],
        single=[1.0],
        two=[1.0, 1.5],
        same=[1.0, 1.0],
        noisy=[1.0, 3.0, 0.5, 2.5, 1.2],
    )
    got = by_profile(trends.trend_regression(df, "postgres", "neo4j", ["profile"]))
    assert {k: v.trend for k, v in got.items()} == {
        "up": "neo4j_improving",
        "slow": "neo4j_slightly_improving",
        "down": "postgres_improving",
        "easy": "postgres_slightly_improving",
        "flat": "stable",
        "single": "insufficient_data",
        "two": "neo4j_improving",
        "same": "stable",
        "noisy": got["noisy"].trend,
    }
    significant = {k for k, v in got.items() if v.has_trend}
    assert significant == {"up", "slow", "down", "easy", "two"}
    up = got["up"]
    assert up.slope == pytest.approx(np.polyfit(range(4), [0.5, 0.7, 0.95, 1.1], 1)[0])
    assert up.r_squared == pytest.approx(np.corrcoef(range(4), [0.5, 0.7, 0.95, 1.1])[0, 1] ** 2)
    assert up.volatility == pytest.approx(np.std([0.5, 0.7, 0.95, 1.1]) / np.mean([0.5, 0.7, 0.95, 1.1]))
    assert (up.current_efficiency, up.efficiency_min, up.data_points) == (1.1, 0.5, 4)
    assert (up.b_wins_trend, up.a_wins_trend) == ("increasing", "decreasing")
    assert (got["two"].p_value, got["same"].p_value) == (0.0, 1.0)


def test_exact_line_counts_as_significant(spark):
    got = trends.trend_regression(history(spark, p=[1.0, 2.0, 3.0]), "a", "b", ["profile"]).first()
    assert got.has_trend and got.p_value == pytest.approx(0.0, abs=1e-6)


def test_halves(spark):
    df = history(spark, p=[1.0, 2.0, 4.0, 5.0, 6.0], two=[1.0, 2.0], down=[3.0, 2.0, 1.0])
    got = by_profile(trends.trend_halves(df, "a", "b", ["profile"]))
    assert got["p"].slope == pytest.approx((statistics.mean([4, 5, 6]) - 1.5) / 2)
    assert (got["p"].trend, got["down"].trend) == ("b_improving", "a_improving")
    assert (got["two"].trend, got["two"].has_trend) == ("insufficient_data", False)


def test_trends_without_keys(spark):
    df = history(spark, p=[1.0, 2.0, 2.5]).drop("profile")
    assert trends.trend_regression(df, "a", "b").first().data_points == 3
    assert trends.trend_halves(df, "a", "b").first().slope == pytest.approx(1.25)


@pytest.mark.parametrize(
    "has_trend, size, eff, slope, vol, rule",
    [
        (False, "tiny", 0.1, -0.5, 0.1, None),
        (True, "tiny", 0.4, -0.2, 0.1, "1"),
        (True, "tiny", 0.4, -0.12, 0.1, None),
        (True, "x-large", 0.4, -0.12, 0.1, "1"),
        (True, "tiny", 2.5, 0.2, 0.1, "2"),
        (True, "tiny", 0.6, -0.12, 0.05, "3a"),
        (True, "tiny", 1.6, 0.1, 0.05, "3b"),
        (True, "tiny", 1.0, 0.1, 0.05, None),
        (True, "tiny", 1.0, -0.4, 0.4, "4"),
        (True, "tiny", 0.4, -0.4, 0.4, "4"),
    ],
)
def test_stop_rules(spark, has_trend, size, eff, slope, vol, rule):
    df = spark.createDataFrame(
        [(has_trend, size, eff, slope, vol)],
        "has_trend boolean, current_size string, current_efficiency double, slope double, volatility double",
    )
    got = trends.stop_rules(df).first()
    assert (got.rule, got.should_stop) == (rule, rule is not None)


CLEAR, UNCLEAR = "высокая", "средняя"


@pytest.mark.parametrize(
    "base, past, significance, improvement, rule, runs",
    [
        (30, [0.2], CLEAR, -400.0, 1, 5),
        (6, [0.2], CLEAR, -400.0, 1, 2),
        (30, [0.2], UNCLEAR, -400.0, 2, 10),
        (6, [0.5], CLEAR, -100.0, 2, 3),
        (30, [2.5], CLEAR, 60.0, 3, 60),
        (80, [2.5], CLEAR, 60.0, 3, 100),
        (25, [2.5], UNCLEAR, 60.0, 4, 37),
        (70, [1.4], CLEAR, 30.0, 4, 80),
        (25, [3.0, 0.9], CLEAR, -350.0, 5, 32),
        (25, [0.8, 0.9], CLEAR, -10.0, 6, 35),
        (25, [1.0, 0.9], CLEAR, -10.0, 7, 20),
        (4, [0.9], CLEAR, -10.0, 7, 5),
        (25, [0.9], CLEAR, -150.0, 0, 25),
        # Only the newest three ratios count.
        (25, [9.0, 1.0, 1.0, 0.9], CLEAR, -10.0, 7, 20),
        (25, [], CLEAR, 0.0, 7, 20),
    ],
)
def test_run_budget(spark, base, past, significance, improvement, rule, runs):
    data = [("q", i, v, significance, improvement) for i, v in enumerate(past)]
    data.append(("other", 0, 1.0, UNCLEAR, 0.0))
    ratios = spark.createDataFrame(
        data,
        "query string, seq long, efficiency_coefficient double, significance string, improvement_percentage double",
    ).selectExpr("*", "'small' AS size")
    base_runs = spark.createDataFrame([("q", base)], "query string, base_runs int")
    got = trends.run_budget(base_runs, ratios, "small").first()
    assert (got.rule, got.new_runs) == (rule, runs)


def test_run_budget_without_history(spark):
    ratios = spark.createDataFrame(
        [],
        "query string, seq long, efficiency_coefficient double, significance string, improvement_percentage double",
    ).selectExpr("*", "'small' AS size")
    base_runs = spark.createDataFrame([("q", 25)], "query string, base_runs int")
    assert tuple(trends.run_budget(base_runs, ratios, "small").first()) == ("q", 25, 0, 25)


def test_run_budget_of_a_query_that_the_previous_size_lacks(spark):
    ratios = spark.createDataFrame(
        [("q", "tiny", 0, 0.2, CLEAR, -80.0), ("other", "small", 1, 1.0, UNCLEAR, 0.0)],
        "query string, size string, seq long, efficiency_coefficient double, significance string, "
        "improvement_percentage double",
    )
    base_runs = spark.createDataFrame([("q", 30)], "query string, base_runs int")
    assert tuple(trends.run_budget(base_runs, ratios, "small").first()) == ("q", 30, 7, 24)
    assert tuple(trends.run_budget(base_runs, ratios, "large").first()) == ("q", 30, 0, 30)


TRIALS = "profile string, size string, seq long, status string, average_efficiency double, overall_winner string"


def test_comparison_and_size_summary(spark):
    df = spark.createDataFrame(
        [
            ("poor", "tiny", 0, "completed", 0.5, "pg"),
            ("poor", "tiny", 1, "completed", 1.5, "neo"),
            ("poor", "small", 2, "load_failed", None, None),
            ("rich", "tiny", 0, "load_failed", None, None),
        ],
        TRIALS,
    )
    assert sorted(tuple(r) for r in trends.config_comparison(df).collect()) == [
        ("poor", 2, 2, 1, 1.5, "neo"),
        ("rich", 1, 0, 1, 1.0, "Unknown"),
    ]
    got = {(r.profile, r["size"]): tuple(r)[2:] for r in trends.size_summary(df).collect()}
    assert got["poor", "tiny"] == (2, 2, 1.0, 1.0, 0.5, 1.5)
    assert got["poor", "small"] == (0, 1, None, None, None, None)


def test_null_keys_are_a_group(spark):
    rows_in = [(None, i, 1.0 + i, 1, 1) for i in range(6)] + [("p", i, 3.0, 1, 1) for i in range(3)]
    schema = "profile string, seq long, average_efficiency double, a_wins_count long, b_wins_count long"
    history = spark.createDataFrame(rows_in, schema)
    halves = {r.profile: r for r in trends.trend_halves(history, "a", "b", ["profile"]).collect()}
    assert set(halves) == {None, "p"}
    assert (halves[None].slope, halves[None].data_points, halves["p"].slope) == (1.0, 6, 0.0)
