import datetime as dt
import json
import os

import pytest

from kinweave import schemas
from kinweave.graph import Graph
from kinweave.operators import analytics, measurements, metrics, quality
from kinweave.sources import results, tabular
from tests.graphs import DAY, graph_of


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def checks(df):
    return {r.check: r.n_violations for r in df.collect()}


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_users_csv_types_and_nulls(spark, tmp_path):
    path = write(
        tmp_path / "users.csv",
        "user_id,name,age,city,registration_date\n0,User_0,18,Moscow,2020-01-02\n1,User_1,,,2021-03-04\n",
    )
    assert rows(tabular.ingest_users(spark, path)) == [
        (0, "User_0", 18, "Moscow", dt.date(2020, 1, 2)),
        (1, "User_1", None, None, dt.date(2021, 3, 4)),
    ]


def test_malformed_rows_load_as_nulls_or_fail(spark, tmp_path):
    path = write(
        tmp_path / "friendships.csv",
        "user_id,friend_id,since\n1,2,2020-01-02\nx,3,2020-01-02\n2,3,soon\n",
    )
    users = graph_of(spark, [(1, 2), (2, 3)]).users
    loaded = tabular.ingest_friendships(spark, path)
    report = checks(quality.integrity_report(users, loaded))
    assert report["missing_friendship_field"] == 2
    with pytest.raises(Exception):
        tabular.ingest_friendships(spark, path, mode="FAILFAST").collect()


def test_integrity_report_counts_planted_violations(spark):
    g = graph_of(spark, [(1, 2), (2, 3)])
    edges = spark.createDataFrame(
        [(1, 2, DAY), (1, 2, DAY), (3, 3, DAY), (9, 1, DAY), (9, 2, DAY), (2, 8, None)],
        "user_id long, friend_id long, since date",
    )
    users = g.users.unionByName(g.users.where("user_id = 1"))
    assert checks(quality.integrity_report(users, edges)) == {
        "duplicate_user_id": 1,
        "duplicate_pair": 1,
        "self_loop": 1,
        "missing_friendship_field": 1,
        "missing_user_field": 0,
        "dangling_user_id": 2,
        "dangling_friend_id": 1,
    }
    assert set(checks(quality.integrity_report(g.users, g.edges)).values()) == {0}


def test_tables_round_trip(spark, tmp_path):
    g = graph_of(spark, [(1, 2), (2, 3), (1, 3)])
    folder = str(tmp_path / "out")
    tabular.write_tables(g.users, g.edges, folder, rows_per_file=2)
    assert rows(tabular.ingest_users(spark, f"{folder}/users.csv")) == rows(g.users)
    assert rows(tabular.ingest_friendships(spark, f"{folder}/friendships.csv")) == rows(g.edges)
    assert rows(spark.read.parquet(f"{folder}/users.parquet")) == rows(g.users)
    assert rows(spark.read.parquet(f"{folder}/friendships.parquet")) == rows(g.edges)
    results.write_metadata(metrics.graph_metadata(g), f"{folder}/metadata")
    assert spark.read.json(f"{folder}/metadata").first().num_friendships == 3


def document(times_a, times_b, dataset="tiny", users=None):
    def entry(times, count):
        return {
            "description": "d",
            "iterations": len(times),
            "times": times,
            "avg_time": sum(times) / len(times) if times else None,
            "results_count": count,
        }

    metadata = {"dataset": dataset, "docker_config": "poor", "timestamp": 1.5}
    if users:
        metadata["users"] = users
    return json.dumps(
        {
            "postgres": {"simple_friends": entry(times_a, 3), "empty": entry([], 0)},
            "neo4j": {"simple_friends": entry(times_b, 4)},
            "efficiency": {"_summary": {"average_efficiency": 1.0}},
            "metadata": metadata,
        },
        indent=2,
    )


@pytest.fixture
def folder(tmp_path):
    for i, (name, text) in enumerate(
        {
            "results_1.json": document([1.0, 3.0], [2.0]),
            "results_2.json": document([5.0], [1.0, 1.0], "small", users=77),
            "results_3.json": "{ broken",
            "other.json": document([9.0], [9.0]),
        }.items()
    ):
        write(tmp_path / name, text)
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(tmp_path)


def test_result_files_flatten(spark, folder):
    flat = results.runs_from_json(spark, folder)
    columns = ["size", "users_n", "engine", "query", "results_count", "iteration", "t"]
    assert set(rows(flat.select(columns).where("t is not null"))) == {
        ("tiny", 10_000, "postgres", "simple_friends", 3, 1, 1.0),
        ("tiny", 10_000, "postgres", "simple_friends", 3, 2, 3.0),
        ("tiny", 10_000, "neo4j", "simple_friends", 4, 1, 2.0),
        ("small", 77, "postgres", "simple_friends", 3, 1, 5.0),
        ("small", 77, "neo4j", "simple_friends", 4, 1, 1.0),
        ("small", 77, "neo4j", "simple_friends", 4, 2, 1.0),
    }
    assert flat.where("query = 'empty' and t is null").count() == 2


def test_every_form_of_an_entry_is_read(spark, tmp_path):
    entries = {
        "bare": [1.0, None, 2.5],
        "mean": {"avg_time": 4.0},
        "both": {"avg_time": 9.0, "times": [3.0], "results_count": 8},
        "nothing": {"description": "x"},
        "no_list": "text",
        "empty": [],
    }
    text = json.dumps({"postgres": entries, "neo4j": [1, 2], "metadata": {"dataset": "tiny", "users": 5}})
    write(tmp_path / "results_1.json", text)
    write(tmp_path / "results_2.json", "[1, 2")
    write(tmp_path / "results_3.json", '{"postgres": {}}')
    write(tmp_path / "results_4.json", " ")
    flat = results.runs_from_json(spark, str(tmp_path))
    assert sorted(rows(flat.select("engine", "query", "results_count", "iteration", "t")), key=repr) == sorted(
        [("postgres", "bare", 0, 1, 1.0), ("postgres", "bare", 0, 2, 2.5), ("postgres", "mean", 0, 1, 4.0), ("postgres", "both", 8, 1, 3.0)]
        + [("postgres", name, 0, None, None) for name in ("nothing", "no_list", "empty")],
        key=repr,
    )
    reasons = results.unreadable_documents(spark, str(tmp_path))
    found = {r.file[-6:-5]: r.reason for r in reasons.collect()}
    assert found == {"2": "not_json", "3": "no_dataset", "4": "not_json"}


def test_efficiency_maps_with_reserved_names(spark, tmp_path):
    efficiency = {
        "simple_friends": {"efficiency_coefficient": 1.5, "postgres_time_ms": 3, "neo4j_time_ms": 2.0, "significance": "x"},
        "cohort_analysis": {"efficiency_coefficient": 0.5},
        "_summary": {"average_efficiency": 1.0, "postgres_wins_count": 1, "neo4j_wins_count": 1, "overall_winner": "postgres"},
        "_other": {"efficiency_coefficient": 7.0},
    }
    write(tmp_path / "results_1.json", json.dumps({"efficiency": efficiency, "metadata": {"dataset": "tiny"}}, indent=1))
    write(tmp_path / "results_2.json", json.dumps({"metadata": {"dataset": "tiny"}}))
    each, whole = results.efficiency_from_json(spark, str(tmp_path))
    assert sorted(rows(each.select("size", "query", "efficiency_coefficient", "a_time_ms", "b_time_ms", "significance"))) == [
        ("tiny", "cohort_analysis", 0.5, None, None, None), ("tiny", "simple_friends", 1.5, 3.0, 2.0, "x"),
    ]
    summary = whole.first()
    assert (summary.average_efficiency, summary.a_wins_count, summary.b_wins_count, summary.overall_winner) == (1.0, 1, 1, "postgres")
    assert whole.count() == 1


def test_newest_files_first_broken_ones_skipped(spark, folder):
    assert results.runs_from_json(spark, folder, newest=1).count() == 0
    newest = results.runs_from_json(spark, folder, newest=2)
    assert {r.size for r in newest.select("size").collect()} == {"small"}


def test_stats_of_result_files(spark, folder):
    flat = results.runs_from_json(spark, folder)
    stats = {
        (r.engine, r.query): r
        for r in measurements.run_stats(flat, newest_by="file_time").collect()
    }
    pooled = stats["postgres", "simple_friends"]
    assert (pooled.n_runs, pooled.min_time, pooled.max_time, pooled.avg_time) == (3, 1.0, 5.0, 3.0)
    assert pooled.std_time == pytest.approx(2.0)
    empty = stats["postgres", "empty"]
    assert (empty.n_runs, empty.avg_time, empty.std_time) == (0, None, None)


def test_fixed_tables(spark):
    assert schemas.size_ladder(spark).count() == 8
    assert schemas.query_classes(spark).groupBy("class").count().collect()[0]["count"] == 5


def test_rows_that_do_not_fit_stand_apart(spark, tmp_path):
    path = write(
        tmp_path / "friendships.csv",
        "user_id,friend_id,since\n1,2,2020-01-02\nx,3,2020-01-02\n2,3,soon\n4,5\n6,7,2020-01-02,8\n8,9,\n",
    )
    fit, refused = tabular.read_checked(spark, path, schemas.FRIENDSHIPS)
    assert rows(fit.select("user_id")) == [(1,), (8,)]
    assert rows(refused.select("unread_row", "friend_id")) == [
        ("2,3,soon", 3), ("4,5", 5), ("6,7,2020-01-02,8", 7), ("x,3,2020-01-02", 3),
    ]
    assert all(r.file.endswith("friendships.csv") for r in refused.collect())


def test_refused_rows_have_the_first_constraint_they_break(spark):
    g = graph_of(spark, [(1, 2), (2, 3)])
    late = dt.date(2030, 1, 1)
    edges = spark.createDataFrame(
        [(1, 2, late), (1, 2, DAY), (1, 2, DAY), (1, 2, None), (2, 1, DAY), (3, 3, DAY), (9, 9, DAY), (9, 1, DAY), (9, 8, DAY)]
        + [(2, 8, DAY)] * 3 + [(None, 2, DAY)],
        "user_id long, friend_id long, since date",
    )
    wanted = {
        (1, 2, late, "duplicate_pair", 1), (1, 2, DAY, "duplicate_pair", 1), (1, 2, None, "missing_field", 1),
        (3, 3, DAY, "self_loop", 1), (9, 9, DAY, "self_loop", 1), (9, 1, DAY, "unknown_user", 1), (9, 8, DAY, "unknown_user", 1),
        (2, 8, DAY, "unknown_friend", 3), (None, 2, DAY, "missing_field", 1),
    }
    refused = quality.rejected_rows(g.users, edges)
    assert {tuple(r) for r in refused.collect()} == wanted
    kept = quality.accepted_edges(g.users, edges)
    assert rows(kept) == [(1, 2, DAY), (2, 1, DAY)]
    assert refused.agg({"n_rows": "sum"}).first()[0] + kept.count() == edges.count()
    assert quality.rejected_rows(g.users, edges.limit(0)).count() == 0


def test_growth_reads_the_years_it_needs(spark, tmp_path):
    days = [dt.date(y, m, 3) for y in range(2010, 2020) for m in (1, 5, 9)]
    edges = spark.createDataFrame(
        [(i, i + 100, day) for i, day in enumerate(days)] + [(90, 91, None)], "user_id long, friend_id long, since date"
    )
    folder = str(tmp_path / "by_year")
    tabular.write_edges_by_year(edges, folder, parts=3)
    stored = tabular.read_edges_by_year(spark, folder)
    assert rows(stored.select(*edges.columns).where("since is not null")) == rows(edges.where("since is not null"))
    assert stored.count() == edges.count()
    users = spark.createDataFrame([], schemas.USERS)
    as_of = dt.date(2018, 5, 3)
    for direction in ("out", "both"):
        grown = analytics.network_growth(Graph(users, stored), direction, as_of=as_of)
        assert rows(grown) == rows(analytics.network_growth(Graph(users, edges), direction, as_of=as_of))
        plan = grown._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(since_year" in plan and ">= 2016)]" in plan


def test_complete_documents_hold_failed_experiments(spark, tmp_path):
    columns = "engine string, query string, size string, users_n long, iteration int, run_no long, source long, profile string, results_count int, t double"
    runs = spark.createDataFrame(
        [
            ("a", "q", "tiny", 10, 1, 1, 1, "p", 5, 2.0), ("a", "q", "tiny", 10, 2, 2, 1, "p", 5, 4.0), ("b", "q", "tiny", 10, 1, 3, 1, "p", 5, 1.5),
            ("a", "q", "odd", 7, 1, 4, 2, "p", 5, 1.0),
        ],
        columns,
    )
    keys = ["profile", "size", "source"]
    ratios = measurements.efficiency(measurements.run_stats(runs, keys), "a", "b", keys)
    summaries = measurements.efficiency_summary(ratios, "a", "b", keys)
    whole = results.complete_documents(runs, ratios, summaries, ("a", "b"))
    folder = str(tmp_path / "complete")
    for _ in range(2):  # a second run replaces its own documents
        results.write_partitioned(whole, folder, "profile", "size")
    results.write_partitioned(whole.where("size = 'odd'"), folder, "profile", "size")
    docs = {d["metadata"]["dataset"]: d for d in (json.loads(r.value) for r in spark.read.text(folder).collect())}
    assert spark.read.text(folder).count() == len(docs) == 2
    assert docs["tiny"]["a"]["q"]["times"] == [2.0, 4.0] and docs["tiny"]["status"] == "completed"
    assert docs["tiny"]["metadata"]["config"]["dataset_size_config"] == {"users": 10_000, "avg_friends": 22, "iterations": 3}
    assert docs["tiny"]["efficiency"]["q"]["efficiency_coefficient"] == 2.0 and results.SUMMARY in docs["tiny"]["efficiency"]
    assert docs["odd"]["efficiency"] == {} and docs["odd"]["status"] == "load_failed" and docs["odd"]["b"] == {}
    flat = results.runs_from_json(spark, folder, ("a", "b"), pattern="part-*", multi_line=False)
    assert rows(flat.select("engine", "size", "t")) == [("a", "odd", 1.0), ("a", "tiny", 2.0), ("a", "tiny", 4.0), ("b", "tiny", 1.5)]
    empty = results.complete_documents(runs.limit(0), ratios.limit(0), summaries.limit(0), ("a", "b"))
    assert empty.count() == 0


@pytest.mark.parametrize("page,sizes", [(2, [2, 2, 1]), (5, [5]), (1_000, [5])])
def test_size_documents_have_bounded_pages(spark, page, sizes):
    trials = spark.createDataFrame(
        [("p", "tiny", i, "completed" if i % 2 else "load_failed", 1.5 if i % 2 else None, "a" if i % 2 else None) for i in (9, 300_000, 5, 7, 1 << 41)],
        "profile string, size string, seq long, status string, average_efficiency double, overall_winner string",
    )
    docs = [json.loads(r.json) for r in results.size_documents(trials, page).orderBy("page").collect()]
    assert [len(d["results"]) for d in docs] == sizes
    assert [r["seq"] for d in docs for r in d["results"]] == [5, 7, 9, 300_000, 1 << 41]
    assert all((d["iterations"], d["successful_iterations"], d["infrastructure_config"]) == (5, 3, "p") for d in docs)
