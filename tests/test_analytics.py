import datetime as dt

import pytest

from kinweave.operators import analytics, edges, metrics
from tests.graphs import DAY, graph_of, random_edges


def rows(df):
    return [tuple(r) for r in df.collect()]


USERS = [
    (1, "a", 20, "X", dt.date(2020, 1, 5)),
    (2, "b", 21, "Y", dt.date(2020, 3, 5)),
    (3, "c", 25, "X", dt.date(2021, 1, 5)),
    (4, "d", 40, None, dt.date(2021, 1, 5)),
    (5, "e", None, "Z", dt.date(2021, 1, 5)),
    (6, "f", 29, "Y", dt.date(2021, 6, 5)),
]
EDGES = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (1, 6)]
DATES = [dt.date(2020, 5, 1), dt.date(2021, 5, 1), dt.date(2021, 2, 1)] + [dt.date(2021, 3, 1)] * 3


@pytest.fixture(scope="module")
def small(spark):
    return graph_of(spark, EDGES, USERS, DATES)


def test_cohorts(small):
    assert rows(analytics.cohort_analysis(small)) == [
        (2020, 5, 1, 1),
        (2021, 3, 2, 2),
    ]
    # Each end against its own registration year.
    assert rows(analytics.cohort_analysis(small, "both")) == [
        (2020, 5, 2, 2),
        (2021, 2, 1, 1),
        (2021, 3, 4, 5),
        (2021, 5, 1, 1),
    ]


def test_cities(small):
    assert rows(analytics.social_cities(small)) == [("X", 2, 1), ("Y", 1, 1)]
    assert rows(analytics.social_cities(small, "both")) == [("X", 3, 1), ("Y", 3, 1)]
    assert rows(analytics.social_cities(small, "both", k=1)) == [("X", 3, 1)]


def test_age_gaps_in_rank_order_and_doubled(small):
    one = [("0-1 год", 1), ("2-5 лет", 2), ("6-10 лет", 1), (">10 лет", 1)]
    assert rows(analytics.age_gap_analysis(small)) == one
    assert rows(analytics.age_gap_analysis(small, "both")) == [(c, 2 * n) for c, n in one]


def test_growth_windows(spark):
    dates = [dt.date(2019, 5, 9), dt.date(2019, 5, 10), dt.date(2020, 1, 1), dt.date(2021, 5, 10)]
    g = graph_of(spark, [(1, 2), (2, 3), (3, 4), (4, 5)], dates=dates)
    # The newest date stands for today.
    assert rows(analytics.network_growth(g)) == [(2019, 5, 1), (2020, 1, 1), (2021, 5, 1)]
    assert rows(analytics.network_growth(g, "both")) == [(2019, 5, 4), (2020, 1, 2), (2021, 5, 2)]
    later = dt.date(2022, 2, 1)
    assert rows(analytics.network_growth(g, as_of=later)) == [(2021, 5, 1)]
    assert rows(analytics.network_growth(g, "both", as_of=later)) == [(2020, 1, 2), (2021, 5, 2)]
    assert rows(analytics.network_growth(g, months=1)) == [(2019, 5, 1)]


def test_age_clustering(small):
    got = rows(analytics.age_clustering(small))
    # Twenties: out-degrees 3, 1, 1, 0. The only user in the forties is left out.
    assert got == [(20, 4, pytest.approx((2 / 3) / 4))]
    both = rows(analytics.age_clustering(small, "both"))
    assert both == [
        (20, 3, pytest.approx((2 / 3 + 1 / 2 + 2 / 3) / 3)),
        (40, 1, pytest.approx(1 / 2)),
    ]


def test_unknown_direction(small):
    for op in (analytics.cohort_analysis, analytics.social_cities, analytics.network_growth):
        with pytest.raises(ValueError):
            op(small, "in")


def test_metrics(spark, small):
    assert rows(metrics.db_metrics_counts(small)) == [(6, 6)]
    assert rows(metrics.graph_metadata(small)) == [(6, 6, 2.0)]
    assert rows(metrics.db_metrics_degree_out(small)) == [(4, 5, 1.0)]
    assert rows(metrics.db_metrics_degree_both(small)) == [(6, 2.0, 1, 3)]
    assert rows(metrics.age_distribution(small.users)) == [(20, 40, 27.0, 25.0)]
    assert len(rows(metrics.graph_counts(small))) == 6
    empty = graph_of(spark, [(1, 1)], USERS)
    assert rows(metrics.graph_metadata(empty)) == [(6, 0, 0.0)]
    assert rows(metrics.db_metrics_degree_out(empty)) == [(0, 0, 0.0)]


def test_pick_pair_is_no_friendship(spark):
    edges = random_edges(30, 60)
    g = graph_of(spark, edges)
    a, b = rows(metrics.pick_pair(g))[0]
    assert a != b and (min(a, b), max(a, b)) not in edges
    # Everyone knows everyone: there is nobody to pick.
    full = graph_of(spark, [(1, 2), (1, 3), (2, 3)])
    assert rows(metrics.pick_pair(full))[0][1] is None


@pytest.mark.parametrize("n", [0, 7, 499, 500, 900, 1999])
def test_nth_candidate_by_narrowing(spark, n):
    from kinweave.functions.ranking import nth_row

    # A third of all rows has one value.
    values = [5] * 700 + list(range(1300))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert rows(nth_row(df, "v", n, width=20)) == [(2000, sorted(values)[n])]
    assert rows(metrics.nth_candidate(df, "v", n)) == [(2000, sorted(values)[n])]


def test_nth_candidate_beyond_the_end(spark):
    df = spark.createDataFrame([(1,), (2,)], "v long")
    assert rows(metrics.nth_candidate(df, "v", 2)) == [(2, None)]


@pytest.mark.parametrize("n", [0, 5, 50, 89, 90, 99, 100])
def test_nth_candidate_with_null_keys(spark, n):
    from kinweave.functions.ranking import nth_row

    df = spark.createDataFrame([(None,)] * 10 + [(v // 2,) for v in range(90)], "v long")
    want = [(100, n // 2 if n < 90 else None)]
    for width in (1, 5, 20, 10_000):
        assert rows(nth_row(df, "v", n, width)) == want


def test_positions_keep_null_keys(spark):
    from kinweave.functions.ranking import positions

    df = spark.createDataFrame([(None if i % 2 else "g", i) for i in range(10)], "g string, v long")
    got = {(r.g, r.v): r.position for r in positions(df, ["g"], "v", width=3).collect()}
    assert got == {(None if i % 2 else "g", i): i // 2 + 1 for i in range(10)}


def test_an_edge_without_an_end_is_not_canonical(spark):
    df = spark.createDataFrame([(1, 2), (3, None)], "user_id long, friend_id long")
    assert rows(edges.is_canonical(df)) == [(False,)]


def test_positions_equal_row_numbers(spark):
    from kinweave.functions.ranking import positions

    df = spark.createDataFrame(
        [(g, 7 * i % 101 - 30) for g in "ab" for i in range(101)], "g string, v long"
    )
    got = positions(df, ["g"], "v", width=10)
    assert {(r.g, r.v): r.position for r in got.collect()} == {
        (g, v): v + 31 for g in "ab" for v in range(-30, 71)
    }


def test_both_doubles_on_random_graph(spark):
    g = graph_of(spark, random_edges(40, 120))
    one = dict(rows(analytics.age_gap_analysis(g)))
    assert dict(rows(analytics.age_gap_analysis(g, "both"))) == {k: 2 * v for k, v in one.items()}
    assert DAY.year == rows(analytics.network_growth(g))[0][0]
