import pytest
from pyspark.sql import functions as F

from kinweave.functions.expressions import format_users, two_sided_p
from kinweave.operators import measurements as m
from kinweave.schemas import query_classes

SCHEMA = "engine string, query string, iteration int, t double, size string, users_n long, source long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def runs(spark):
    data = [
        ("pg", "simple_friends", 1, 1.0, "s", 10, 0),
        ("pg", "simple_friends", 2, 3.0, "s", 10, 0),
        ("pg", "simple_friends", 3, 8.0, "s", 10, 1),
        ("neo", "simple_friends", 1, 2.0, "s", 10, 0),
        ("neo", "social_cities", 1, 0.5, "s", 10, 0),
        ("pg", "social_cities", 1, 4.0, "s", 10, 0),
        ("pg", "only_pg", 1, 1.0, "s", 10, 0),
        ("pg", "zero", 1, 0.0, "s", 10, 0),
        ("neo", "zero", 1, 1.0, "s", 10, 0),
        ("pg", "social_cities", 1, 16.0, "l", 99, 2),
        ("neo", "social_cities", 1, 1.9, "l", 99, 2),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_stats(runs):
    stats = {(r.engine, r.query): r for r in m.run_stats(runs).collect()}
    one = stats["pg", "simple_friends"]
    assert (one.n_runs, one.min_time, one.max_time, one.avg_time) == (3, 1.0, 8.0, 4.0)
    assert one.std_time == pytest.approx(13**0.5)
    assert stats["neo", "simple_friends"].std_time == 0.0


def test_warm_up_goes_by_iteration_number(runs):
    assert rows(m.run_stats_warm(runs)) == [("pg", "simple_friends", 1, 8.0, 8.0, 8.0, 0.0)]


def test_means_of_means_and_counts(runs):
    means = {(r.size, r.engine, r.query): r.mean_time for r in m.dataset_means(runs, "source").collect()}
    assert means["s", "pg", "simple_friends"] == 5.0
    assert rows(m.run_counts(runs, ["pg", "neo"], "source")) == [("l", 1, 1), ("s", 5, 3)]


def test_efficiency_and_summary(spark, runs):
    small = runs.where("size = 's'")
    ratios = m.efficiency(m.run_stats(small), "pg", "neo")
    got = {r.query: r for r in ratios.collect()}
    assert set(got) == {"simple_friends", "social_cities"}
    one = got["simple_friends"]
    assert (one.efficiency_coefficient, one.improvement_percentage) == (2.0, 50.0)
    assert (one.a_time_ms, one.b_time_ms, one.significance) == (4000.0, 2000.0, "средняя")
    assert got["social_cities"].significance == "высокая"
    summary = m.efficiency_summary(ratios, "pg", "neo").first()
    assert (summary.average_efficiency, summary.median_efficiency) == (5.0, 5.0)
    assert (summary.a_wins_count, summary.b_wins_count, summary.total_comparisons) == (0, 2, 2)
    assert (summary.overall_winner, summary.performance_advantage) == ("neo", "400.0%")
    by_class = m.efficiency_by_class(ratios, query_classes(spark))
    assert rows(by_class) == [("analytical", 8.0, 1, 1), ("graph", 2.0, 1, 1)]
    assert [tuple(r) for r in m.fastest_queries(ratios, "pg", "neo", 1).collect()] == [
        ("social_cities", 8.0, "neo", 8.0)
    ]


def test_no_comparison_gives_no_summary(runs):
    none = m.efficiency(m.run_stats(runs.where("engine = 'pg'")), "pg", "neo")
    assert m.efficiency_summary(none, "pg", "neo").count() == 0


def test_engine_ratio_keeps_unmatched_queries(runs):
    got = {r.query: (r.a_ms, r.b_ms, r.ratio) for r in m.engine_ratio(
        m.run_stats(runs.where("size = 's'")), "pg", "neo").collect()}
    assert got["only_pg"] == (1000.0, None, None)
    assert got["simple_friends"] == (4000.0, 2000.0, 2.0)
    assert got["zero"] == (0.0, 1000.0, 0.0)
    swapped = m.engine_ratio(m.run_stats(runs.where("query = 'zero'")), "neo", "pg")
    assert swapped.first().ratio is None


def test_points_wins_and_degradations(runs):
    pts = m.points(m.dataset_means(runs, "source"), "pg", "neo").where("query = 'social_cities'")
    assert rows(pts) == [("social_cities", 10, 4.0, 0.5), ("social_cities", 99, 16.0, 1.9)]
    assert rows(m.wins_by_size(pts, "pg", "neo")) == [
        ("social_cities", 10, "neo"),
        ("social_cities", 99, "neo"),
    ]
    assert rows(m.degradations(pts, "pg", "neo")) == [("social_cities", "pg", 99, 4.0)]


def test_format_users(spark):
    df = spark.createDataFrame([(None,), (999,), (5000,), (1_000_000,), (2_500_000,)], "n long")
    assert [r[0] for r in df.select(format_users(F.col("n"))).collect()] == [
        "N/A",
        "999",
        "5k",
        "1.0M",
        "2.5M",
    ]


def test_p_values_at_known_critical_points(spark):
    # Two-sided 10% points of Student's t, from published tables.
    known = {1: 6.3138, 2: 2.9200, 3: 2.3534, 4: 2.1318, 5: 2.0150, 8: 1.8595, 15: 1.7531, 120: 1.6577}
    df = spark.createDataFrame([(n, t) for n, t in known.items()], "n long, t double")
    for row in df.select(two_sided_p(F.col("t"), F.col("n")).alias("p")).collect():
        assert row.p == pytest.approx(0.1, abs=2e-5)
    zero = spark.createDataFrame([(3, 0.0), (4, 0.0)], "n long, t double")
    assert [r[0] for r in zero.select(two_sided_p(F.col("t"), F.col("n"))).collect()] == [1.0, 1.0]


def test_ratios_are_rounded_once(spark):
    stats = spark.createDataFrame(
        [("a", "q", 1.00499999996, 0.0, 1), ("b", "q", 1.0, 0.0, 1)],
        "engine string, query string, avg_time double, std_time double, results_count int",
    )
    assert m.efficiency(stats, "a", "b").first().efficiency_coefficient == 1.0


def test_points_are_finite(spark):
    means = spark.createDataFrame(
        [(e, "q", n, v) for n, v in enumerate([1.0, float("nan"), float("inf"), None]) for e in "ab"],
        "engine string, query string, users_n long, mean_time double",
    )
    assert [r.users_n for r in m.points(means, "a", "b").collect()] == [0]


def exact_p(t, n):
    """Two-sided p for an even n, from the finite series in 60 digits."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    square = Decimal(t) * Decimal(t)
    cos2 = Decimal(n) / (Decimal(n) + square)
    term = total = Decimal(1)
    for j in range(1, n // 2):
        term *= cos2 * (2 * j - 1) / (2 * j)
        total += term
    return float(1 - (1 - cos2).sqrt() * total)


def test_p_values_keep_their_digits(spark):
    cases = [(t, n) for t in (0.01, 0.5, 1.0, 2.0, 5.0, 12.0, 40.0) for n in (2, 4, 10, 38, 200, 5000)]
    df = spark.createDataFrame(cases, "t double, n long")
    for row in df.select("t", "n", two_sided_p(F.col("t"), F.col("n")).alias("p")).collect():
        want = exact_p(row.t, row.n)
        if want > 1e-45:
            assert row.p == pytest.approx(want, rel=1e-6), (row.t, row.n)
