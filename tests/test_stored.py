"""The stored neighbour lists: equal answers, and plans that don't shuffle the lists."""

import re

import pytest

from kinweave.operators import neighbourhood as near
from kinweave.operators import stored
from tests.graphs import graph_of, random_edges


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def lists(spark, tmp_path):
    graph = graph_of(spark, random_edges(60, 80, hubs=(0, 9)))
    yield graph, stored.store_lists(graph, "adjacency_test", str(tmp_path), chunk=4)
    stored.drop_lists(spark, "adjacency_test")


def test_answers_equal_those_of_the_edges(spark, lists):
    graph, kept = lists
    assert kept.lists.where("src = 0").count() > 2  # a hub has several lists
    some = spark.createDataFrame([(0,), (3,), (3,), (None,), (99,)], "seed long")
    for seeds in (graph.seeds, some, some.limit(0)):
        unique = near.distinct_seeds(seeds)
        assert rows(stored.simple_friends(kept, seeds)) == rows(near.simple_friends(graph, unique))
        assert rows(stored.friends_of_friends(kept, seeds)) == rows(near.friends_of_friends(graph, unique))


def test_lists_are_read_in_place(spark, lists):
    graph, kept = lists
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored.simple_friends(kept, graph.seeds)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    scans = re.findall(r"FileScan parquet spark_catalog.default.adjacency_test_\w+\[.*", plan)
    assert len(scans) == 2 and all("Bucketed: true" in scan for scan in scans)
    # No exchange stands between a join and a stored table.
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = next(later for later in lines[at + 1 :] if re.search(r"Scan|Join|Aggregate|Generate", later))
            assert "adjacency_test" not in below, plan


def test_storing_again_replaces_the_lists(spark, lists, tmp_path):
    again = graph_of(spark, [(1, 2)])
    kept = stored.store_lists(again, "adjacency_test", str(tmp_path))
    assert rows(stored.simple_friends(kept, again.seeds)) == [(1, 2), (2, 1)]


def test_empty_graph(spark, tmp_path):
    graph = graph_of(spark, [(1, 2)])
    nothing = type(graph)(graph.users, graph.edges.where("user_id < 0"))
    kept = stored.store_lists(nothing, "adjacency_none", str(tmp_path))
    assert rows(stored.simple_friends(kept, graph.seeds)) == []
    stored.drop_lists(spark, "adjacency_none")
