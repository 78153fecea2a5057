"""Time the headline queries: one JSON line on stdout.

Like the published workload, data preparation is timed apart ("prepare") and the
queries read the prepared tables. Neighbourhood and path queries answer for every
user or pair of the tables in one job; "per_item_ms" divides their time by the number
of users or pairs, "items", to compare with per-user latencies. Every query gets one
untimed run, then the mean of the timed runs counts; a query whose untimed run takes more
than SLOW seconds is timed once. Figures go to stderr as they come.

No query can take the whole bench: what runs longer than BENCH_LIMIT seconds is stopped
and listed under "stopped" (it counts with the limit), and after BENCH_BUDGET seconds the rest is "skipped". The
headline queries come first, those on the skewed graph last.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set input folder, cores and timed runs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from kinweave.graph import Graph  # noqa: E402
from kinweave.operators import analytics, metrics  # noqa: E402
from kinweave.operators import neighbourhood as near  # noqa: E402
from kinweave.operators.paths import shortest_path  # noqa: E402
from kinweave.plans import catalog  # noqa: E402
from kinweave.session import build_session, scratch_path  # noqa: E402
from kinweave.sources import supplied, tabular  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
LIMIT = float(os.environ.get("BENCH_LIMIT", "120"))
BUDGET = float(os.environ.get("BENCH_BUDGET", "840"))
SLOW = 15.0


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


class Stopped(Exception):
    """A query ran beyond its limit."""


def timed(spark, query) -> float:
    """Seconds of one run; its jobs are cancelled at the limit."""
    late = threading.Event()

    def stop() -> None:
        late.set()
        while not over.wait(1):  # jobs that begin after the first call too
            spark.sparkContext.cancelAllJobs()

    over, timer = threading.Event(), threading.Timer(LIMIT, stop)
    timer.daemon = True
    start = time.perf_counter()
    timer.start()
    try:
        drain(query())
    except Exception:
        if late.is_set():
            raise Stopped from None
        raise
    finally:
        over.set()
        timer.cancel()
    return time.perf_counter() - start


def main() -> None:
    began = time.perf_counter()
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="kinweave-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    start = time.perf_counter()
    folder = scratch_path(spark, "bench")
    derived = supplied.load_graph(spark, SF_DIR)
    tabular.write_tables(derived.users, derived.edges, folder)
    pairs_path, far_path = f"{folder}/pairs.parquet", f"{folder}/far_pairs.parquet"
    supplied.pairs(spark, SF_DIR, catalog.PAIR_GAP).write.parquet(pairs_path)
    supplied.pairs(spark, SF_DIR, catalog.PATH_GAP).write.parquet(far_path)
    times["prepare"] = time.perf_counter() - start

    read = spark.read.parquet
    graph = Graph(read(f"{folder}/users.parquet"), read(f"{folder}/friendships.parquet"))
    pairs, far_pairs = read(pairs_path), read(far_path)
    one = catalog.busiest_user(graph).first().seed
    users = graph.users.count()
    items = {
        "simple_friends": users,
        "friends_of_friends": users,
        "mutual_friends": pairs.count(),
        "friend_recommendations_batch": users,
        "shortest_path": far_pairs.count(),
        "shortest_path_directed": far_pairs.count(),
    }
    measured = lambda: supplied.runs(spark, SF_DIR)
    queries = {
        "simple_friends": lambda: near.simple_friends(graph, graph.seeds),
        "friends_of_friends": lambda: near.friends_of_friends(graph, graph.seeds),
        "mutual_friends": lambda: near.mutual_friends(graph, pairs),
        "friend_recommendations_batch": lambda: near.friend_recommendations(graph, graph.seeds),
        "shortest_path": lambda: shortest_path(graph, far_pairs),
        "shortest_path_directed": lambda: shortest_path(graph, far_pairs, "out"),
        "simple_friends_one": lambda: near.simple_friends(graph, one),
        "friends_of_friends_one": lambda: near.friends_of_friends(graph, one),
        "friend_recommendations_one": lambda: near.friend_recommendations(graph, one).orderBy(
            "rank"
        ),
        "db_metrics_degree_both": lambda: metrics.db_metrics_degree_both(graph),
        "age_distribution": lambda: metrics.age_distribution(graph.users),
        "run_stats": lambda: catalog.measurements.run_stats(measured()),
        "efficiency": lambda: catalog.experiment_ratios(measured()),
        "crossovers": lambda: catalog.curves.crossovers(catalog.curve(measured()), "a", "b"),
        "trend_regression": lambda: catalog.trend(measured()),
    }
    for name in ("nth_candidate", "pick_pair", "integrity_report", "resolved_edges", "run_budget"):
        queries[name] = lambda query=catalog.QUERIES[name]: query(spark, SF_DIR)
    for name in (
        "cohort_analysis",
        "social_cities",
        "age_gap_analysis",
        "network_growth",
        "age_clustering",
    ):
        for suffix, direction in (("", "out"), ("_both", "both")):
            queries[name + suffix] = lambda op=getattr(analytics, name), d=direction: op(graph, d)

    skewed = supplied.load_skewed_graph(spark, SF_DIR)
    tabular.write_tables(skewed.users, skewed.edges, f"{folder}/skewed")
    skewed = Graph(
        read(f"{folder}/skewed/users.parquet"), read(f"{folder}/skewed/friendships.parquet")
    )
    queries["friends_of_friends_skewed"] = lambda: near.friends_of_friends(skewed, skewed.seeds)
    queries["friend_recommendations_skewed"] = lambda: near.friend_recommendations(
        skewed, skewed.seeds
    )
    only = os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else queries
    stopped, skipped = [], []
    for name in only:
        if time.perf_counter() - began > BUDGET:
            skipped.append(name)
            continue
        try:
            runs = 1 if timed(spark, queries[name]) > SLOW else RUNS
            times[name] = sum(timed(spark, queries[name]) for _ in range(runs)) / runs
            print(f"{name} {times[name]:.3f}", file=sys.stderr, flush=True)
        except Stopped:
            stopped.append(name)
            print(f"{name} stopped after {LIMIT:.0f} s", file=sys.stderr, flush=True)

    shown = {k: round(v, 4) for k, v in times.items()}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(v for k, v in times.items() if k != "prepare") + LIMIT * len(stopped), 4),
                "unit": "sec",
                "queries": shown,
                "stopped": stopped,
                "skipped": skipped,
                "per_item_ms": {
                    k: round(times[k] * 1000 / n, 5) for k, n in items.items() if k in times
                },
                "items": items,
                "friendships": graph.edges.agg(F.count(F.lit(1))).first()[0],
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
