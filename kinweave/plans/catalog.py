"""The registered queries: every operator over the whole supplied tables.

Each entry takes (spark, sf_dir) and returns a DataFrame. Doubles are rounded for
comparison only here, never inside an operator.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.expressions import rounded
from kinweave.graph import Graph
from kinweave.operators import analytics, curves, edges, measurements, metrics, quality, stored, trends
from kinweave.operators import neighbourhood as near
from kinweave.operators.paths import path_text, shortest_path
from kinweave.session import scratch_path
from kinweave.sources import results, supplied, tabular
from kinweave.sources.supplied import A, B

Query = Callable[[SparkSession, str], DataFrame]

PAIR_GAP, PATH_GAP = 2, 5
GROWTH_DAY = dt.date(2001, 3, 15)
PREVIOUS_SIZE = "small"
SIZE_PAGE = 3
EXPERIMENT = ["profile", "size", "size_idx", "source"]


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})


def on_graph(op: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(supplied.load_graph(spark, sf_dir))


def on_runs(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(supplied.runs(spark, sf_dir))


# -- neighbourhoods and paths


def busiest_user(graph: Graph) -> DataFrame:
    """The user with most friends as a one-row seed table."""
    deg = edges.degrees(graph.adj)
    return deg.orderBy(F.desc("degree"), "node").limit(1).select(F.col("node").alias("seed"))


def mutual_friends(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = supplied.load_graph(spark, sf_dir)
    return near.mutual_friends(graph, supplied.pairs(spark, sf_dir, PAIR_GAP))


def mutual_friends_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = supplied.load_skewed_graph(spark, sf_dir)
    return near.mutual_friends(graph, supplied.skewed_pairs(spark, sf_dir, PAIR_GAP))


def on_skewed_graph(op: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(supplied.load_skewed_graph(spark, sf_dir))


def on_stored_lists(op: Callable[[stored.StoredLists, DataFrame], DataFrame]) -> Query:
    """A question to the graph's neighbour lists, stored in buckets first."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = supplied.load_graph(spark, sf_dir)
        folder = scratch_path(spark, "lists")
        table = "adjacency_" + folder.rpartition("-")[2]
        return op(stored.store_lists(graph, table, folder), graph.seeds)

    return query


def top_for_one(graph: Graph) -> DataFrame:
    ranked = near.friend_recommendations(graph, busiest_user(graph))
    return ranked.orderBy("rank").select("cand", "common_friends")


def paths(direction: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = supplied.load_graph(spark, sf_dir)
        found = shortest_path(graph, supplied.pairs(spark, sf_dir, PATH_GAP), direction)
        return found.withColumn("path", path_text())

    return query


def paths_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in a graph with two hubs, each of which also stands in a pair with every user."""
    graph = supplied.load_skewed_graph(spark, sf_dir)
    found = shortest_path(graph, supplied.skewed_pairs(spark, sf_dir, PATH_GAP))
    return found.withColumn("path", path_text())


# -- measurements


def experiment_stats(runs: DataFrame) -> DataFrame:
    return measurements.run_stats(runs, EXPERIMENT, newest_by="run_no")


def experiment_ratios(runs: DataFrame) -> DataFrame:
    return measurements.efficiency(experiment_stats(runs), A, B, EXPERIMENT)


def sequence() -> F.Column:
    """Place of an experiment in its profile: by size, then by file."""
    return F.shiftleft(F.col("size_idx").cast("long"), 40) + F.col("source")


def trials(runs: DataFrame) -> DataFrame:
    """One row per experiment; one that measured a single engine failed and has no ratio."""
    summary = measurements.efficiency_summary(experiment_ratios(runs), A, B, EXPERIMENT)
    measured = ["average_efficiency", "overall_winner", "a_wins_count", "b_wins_count"]
    found = summary.select(*EXPERIMENT, *measured)
    return (
        runs.select(*EXPERIMENT)
        .distinct()
        .join(found, EXPERIMENT, "left")
        .withColumn("seq", sequence())
        .withColumn(
            "status", F.when(F.col("average_efficiency").isNull(), "load_failed").otherwise("completed")
        )
    )


def histories(runs: DataFrame) -> DataFrame:
    """For each profile and size the experiments of all smaller sizes."""
    labels = F.array(*[F.lit(label) for label, _ in supplied.SIZES])
    later = F.sequence(F.col("size_idx") + 1, F.lit(len(supplied.SIZES)))
    return (
        trials(runs)
        .withColumn("next_idx", F.explode(later))
        .withColumn(
            "current_size",
            F.when(F.col("next_idx") < len(supplied.SIZES), F.get(labels, "next_idx")).otherwise(
                "end"
            ),
        )
    )


TREND_KEYS = ["profile", "current_size"]
TREND_VALUES = [
    "slope",
    "volatility",
    "efficiency_min",
    "efficiency_max",
    "current_efficiency",
]


def trend(runs: DataFrame) -> DataFrame:
    return trends.trend_regression(histories(runs), A, B, TREND_KEYS)


def halves(runs: DataFrame) -> DataFrame:
    return _round(trends.trend_halves(histories(runs), A, B, TREND_KEYS), *TREND_VALUES)


def stops(runs: DataFrame) -> DataFrame:
    ruled = trends.stop_rules(trend(runs))
    return ruled.select(*TREND_KEYS, "has_trend", "rule", "should_stop")


def budget(runs: DataFrame) -> DataFrame:
    base = runs.groupBy("profile", "query").agg(
        (F.floor(F.count(F.lit(1)) / 10) + 1).cast("int").alias("base_runs")
    )
    ratios = experiment_ratios(runs).withColumn("seq", sequence())
    return trends.run_budget(base, ratios, PREVIOUS_SIZE, ["profile"])


def classes(runs: DataFrame) -> DataFrame:
    spark = runs.sparkSession
    named = spark.createDataFrame(
        [
            ("click", "graph"),
            ("view", "graph"),
            ("purchase", "analytical"),
            ("signup", "analytical"),
            ("error", "analytical"),
        ],
        "query string, class string",
    )
    by_class = measurements.efficiency_by_class(experiment_ratios(runs), named, EXPERIMENT)
    return _round(by_class, "avg_efficiency")


def pooled_ratios(runs: DataFrame) -> DataFrame:
    return measurements.efficiency(measurements.run_stats(runs), A, B)


def size_points(runs: DataFrame) -> DataFrame:
    return measurements.points(measurements.dataset_means(runs, "source"), A, B)


def curve(runs: DataFrame) -> DataFrame:
    return curves.pchip_curve(size_points(runs))


TIMES = ["min_time", "max_time", "avg_time", "std_time"]


# -- files


def round_trip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "documents")
    results.write_documents(results.documents_of(supplied.runs(spark, sf_dir), (A, B)), folder)
    flat = results.runs_from_json(spark, folder, (A, B), pattern="part-*", multi_line=False)
    return _round(flat.drop("file", "file_time"), "t")


def published_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratios and summaries of efficiency maps that were written as documents."""
    ratios = experiment_ratios(supplied.runs(spark, sf_dir))
    summaries = measurements.efficiency_summary(ratios, A, B, EXPERIMENT)
    folder = scratch_path(spark, "efficiency")
    results.write_documents(results.efficiency_documents(ratios, summaries, (A, B)), folder)
    each, whole = results.efficiency_from_json(spark, folder, (A, B), pattern="part-*", multi_line=False)
    shown = ["profile", "size", "query", "efficiency_coefficient", "improvement_percentage", "a_time_ms", "b_time_ms", "significance"]
    named = whole.select("profile", "size", F.lit(results.SUMMARY).alias("query"), F.col("average_efficiency").alias("efficiency_coefficient"), F.col("overall_winner").alias("significance"))
    return each.select(*shown).unionByName(named, allowMissingColumns=True)


def complete_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole result documents written twice and read back: counts by engine, size and profile."""
    runs, graph = supplied.runs(spark, sf_dir), supplied.load_graph(spark, sf_dir)
    ratios = experiment_ratios(runs)
    summaries = measurements.efficiency_summary(ratios, A, B, EXPERIMENT)
    counts = metrics.db_metrics_counts(graph)
    loaded = F.struct(
        counts.select("users_count").scalar().alias("users_count"),
        counts.select("friendships_count").scalar().alias("friendships_count"),
    )
    whole = results.complete_documents(runs, ratios, summaries, (A, B), loaded)
    folder = scratch_path(spark, "complete")
    for _ in range(2):
        results.write_partitioned(whole, folder, "profile", "size")
    read = results.read_documents(spark, folder, pattern="part-*", multi_line=False)
    status = F.try_variant_get("doc", "$.status", "string")
    users_count = F.try_variant_get("doc", "$.metadata.dataset_size.users_count", "long")
    found = read.groupBy("profile", "size", status.alias("status"), users_count.alias("users_count")).agg(
        F.count(F.lit(1)).alias("documents")
    )
    flat = results.runs_from_json(spark, folder, (A, B), pattern="part-*", multi_line=False)
    times = flat.groupBy("profile", "size").agg(F.count("t").alias("n_times"), F.round(F.sum("t"), 3).alias("sum_times"))
    each, _ = results.efficiency_from_json(spark, folder, (A, B), pattern="part-*", multi_line=False)
    mapped = each.groupBy("profile", "size").agg(F.count(F.lit(1)).alias("n_ratios"))
    return found.join(times, ["profile", "size"]).join(mapped, ["profile", "size"], "left")


def size_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sizes, a page of few experiments each, written and read back."""
    pages = results.size_documents(trials(supplied.runs(spark, sf_dir)), SIZE_PAGE)
    folder = scratch_path(spark, "sizes")
    results.write_partitioned(pages, folder, "profile", "size")
    doc = F.parse_json("value")
    read = spark.read.option("pathGlobFilter", "part-*").text(folder).select(doc.alias("doc"))

    def field(place: str, kind: str, name: str) -> F.Column:
        return F.variant_get("doc", place, kind).alias(name)

    found = read.select(
        field("$.infrastructure_config", "string", "profile"),
        field("$.size", "string", "size"),
        field("$.page", "long", "page"),
        field("$.iterations", "long", "iterations"),
        field("$.successful_iterations", "long", "successful_iterations"),
        F.explode(F.variant_get("doc", "$.results", "array<struct<seq:long,status:string,average_efficiency:double>>")).alias("r"),
    )
    return found.select("profile", "size", "page", "iterations", "successful_iterations", "r.*")


def round_trip_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "users")
    tabular.write_csv(supplied.users(spark, sf_dir), folder)
    return tabular.ingest_users(spark, folder)


def round_trip_friendships(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "friendships")
    tabular.write_csv(supplied.load_graph(spark, sf_dir).edges, folder)
    return tabular.ingest_friendships(spark, folder)


def growth_of_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth up to a stated day over friendships stored by year."""
    folder = scratch_path(spark, "edges-by-year")
    graph = supplied.load_graph(spark, sf_dir)
    tabular.write_edges_by_year(graph.edges, folder)
    stored = Graph(graph.users, tabular.read_edges_by_year(spark, folder))
    return analytics.network_growth(stored, "out", as_of=GROWTH_DAY)


def analytic(op: Callable[..., DataFrame], direction: str, *doubles: str) -> Query:
    return on_graph(lambda g: _round(op(g, direction), *doubles))


QUERIES: dict[str, Query] = {
    # neighbourhoods and paths
    "simple_friends_stored": on_stored_lists(stored.simple_friends),
    "friends_of_friends_stored": on_stored_lists(stored.friends_of_friends),
    "simple_friends": on_graph(lambda g: near.simple_friends(g, g.seeds)),
    "friends_of_friends": on_graph(lambda g: near.friends_of_friends(g, g.seeds)),
    "mutual_friends": mutual_friends,
    "friend_recommendations": on_graph(top_for_one),
    "friend_recommendations_batch": on_graph(
        lambda g: near.friend_recommendations(g, g.seeds)
    ),
    "friends_of_friends_skewed": on_skewed_graph(lambda g: near.friends_of_friends(g, g.seeds)),
    "mutual_friends_skewed": mutual_friends_skewed,
    "friend_recommendations_skewed": on_skewed_graph(
        lambda g: near.friend_recommendations(g, g.seeds)
    ),
    "shortest_path": paths("both"),
    "shortest_path_directed": paths("out"),
    "shortest_path_skewed": paths_skewed,
    # network analytics
    "cohort_analysis": analytic(analytics.cohort_analysis, "out"),
    "cohort_analysis_both": analytic(analytics.cohort_analysis, "both"),
    "social_cities": analytic(analytics.social_cities, "out"),
    "social_cities_both": analytic(analytics.social_cities, "both"),
    "age_gap_analysis": analytic(analytics.age_gap_analysis, "out"),
    "age_gap_analysis_both": analytic(analytics.age_gap_analysis, "both"),
    "network_growth": analytic(analytics.network_growth, "out"),
    "network_growth_both": analytic(analytics.network_growth, "both"),
    "network_growth_as_of": growth_of_stored,
    "age_clustering": analytic(analytics.age_clustering, "out", "clustering_estimate"),
    "age_clustering_both": analytic(analytics.age_clustering, "both", "clustering_estimate"),
    # metrics and counts
    "db_metrics_counts": on_graph(metrics.db_metrics_counts),
    "db_metrics_degree_out": on_graph(
        lambda g: _round(metrics.db_metrics_degree_out(g), "avg_friends_per_user")
    ),
    "db_metrics_degree_both": on_graph(
        lambda g: _round(metrics.db_metrics_degree_both(g), "avg_degree")
    ),
    "age_distribution": lambda spark, sf_dir: _round(
        metrics.age_distribution(supplied.users(spark, sf_dir)), "avg_age", "median_age"
    ),
    "graph_counts": on_graph(metrics.graph_counts),
    "graph_metadata": on_graph(lambda g: _round(metrics.graph_metadata(g), "avg_degree")),
    "pick_pair": on_graph(metrics.pick_pair),
    "nth_candidate": on_graph(
        lambda g: metrics.nth_candidate(edges.degrees(g.adj), "node", 100)
    ),
    "nth_candidate_repeated": on_graph(
        lambda g: metrics.nth_candidate(supplied.users_by_age(g.users), "age", 700)
    ),
    # measurements
    "runs_from_json": round_trip_documents,
    "run_stats": on_runs(
        lambda r: _round(measurements.run_stats(r, newest_by="run_no"), *TIMES)
    ),
    "run_stats_warm": on_runs(lambda r: _round(measurements.run_stats_warm(r), *TIMES)),
    "dataset_means": on_runs(
        lambda r: _round(measurements.dataset_means(r, "source"), "mean_time")
    ),
    "run_counts": on_runs(lambda r: measurements.run_counts(r, [A, B], "source")),
    "efficiency": on_runs(experiment_ratios),
    "efficiency_summary": on_runs(
        lambda r: measurements.efficiency_summary(experiment_ratios(r), A, B, EXPERIMENT)
    ),
    "efficiency_from_json": published_ratios,
    "complete_documents": complete_round_trip,
    "size_documents": size_documents,
    "efficiency_by_class": on_runs(classes),
    "fastest_queries": on_runs(lambda r: measurements.fastest_queries(pooled_ratios(r), A, B)),
    "engine_ratio": on_runs(lambda r: measurements.engine_ratio(measurements.run_stats(r), A, B)),
    "wins_by_size": on_runs(lambda r: measurements.wins_by_size(size_points(r), A, B)),
    "degradations": on_runs(
        lambda r: _round(measurements.degradations(size_points(r), A, B), "growth")
    ),
    "pchip_curve": on_runs(lambda r: _round(curve(r), "x", "a", "b")),
    "crossovers": on_runs(lambda r: _round(curves.crossovers(curve(r), A, B), "critical")),
    "max_gap": on_runs(
        lambda r: _round(curves.max_gap(curve(r), A, B), "max_rel_pct", "x_at_max")
    ),
    "global_threshold": on_runs(
        lambda r: curves.global_threshold(curves.crossovers(curve(r), A, B))
    ),
    "trend_regression": on_runs(
        lambda r: _round(trend(r), *TREND_VALUES, "r_squared", "p_value")
    ),
    "trend_halves": on_runs(halves),
    "stop_rules": on_runs(stops),
    "run_budget": on_runs(budget),
    "config_comparison": on_runs(lambda r: trends.config_comparison(trials(r))),
    "size_summary": on_runs(
        lambda r: _round(
            trends.size_summary(trials(r)), "avg_efficiency", "median_efficiency", digits=6
        )
    ),
    # data preparation
    "canonical_edges": lambda spark, sf_dir: edges.canonical_edges(
        supplied.raw_edges(spark, sf_dir)
    ),
    "is_canonical": on_graph(lambda g: edges.is_canonical(g.edges)),
    "adjacency": on_graph(lambda g: edges.adjacency(g.edges)),
    "ingest_users": round_trip_users,
    "ingest_friendships": round_trip_friendships,
    "resolved_edges": lambda spark, sf_dir: edges.resolved_edges(
        supplied.dangling_edges(spark, sf_dir), supplied.users(spark, sf_dir)
    ),
    "integrity_report": lambda spark, sf_dir: quality.integrity_report(
        supplied.users(spark, sf_dir), supplied.dangling_edges(spark, sf_dir)
    ),
    "accepted_edges": lambda spark, sf_dir: quality.accepted_edges(
        supplied.users(spark, sf_dir), supplied.dangling_edges(spark, sf_dir)
    ),
    "rejected_rows": lambda spark, sf_dir: quality.rejected_rows(
        supplied.users(spark, sf_dir), supplied.dangling_edges(spark, sf_dir)
    ),
}
