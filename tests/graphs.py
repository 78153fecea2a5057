"""Small graphs and brute-force answers."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict

from kinweave import schemas
from kinweave.graph import Graph

DAY = dt.date(2020, 1, 1)


def graph_of(spark, edges, users=None, dates=None):
    """A graph from raw pairs; users default to the ids that occur."""
    ids = {x for e in edges for x in e}
    users = users or [(i, f"User_{i}", 18 + i % 50, f"City_{i % 3}", DAY) for i in sorted(ids)]
    dates = dates or [DAY] * len(edges)
    raw = spark.createDataFrame(
        [(a, b, d) for (a, b), d in zip(edges, dates)], schemas.FRIENDSHIPS
    )
    return Graph.from_raw(spark.createDataFrame(users, schemas.USERS), raw)


def random_edges(n, m, hubs=(), seed=1):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    for hub in hubs:
        edges |= {tuple(sorted((hub, x))) for x in rng.sample(range(n), n // 3) if x != hub}
    return sorted(edges)


def adjacency_sets(edges, direction="both"):
    adj = defaultdict(set)
    for a, b in edges:
        a, b = min(a, b), max(a, b)
        if a == b:
            continue
        adj[a].add(b)
        if direction == "both":
            adj[b].add(a)
    return adj


def recommendations(adj, seed, k=10):
    counts = Counter(c for f in adj[seed] for c in adj[f] if c != seed and c not in adj[seed])
    ranked = sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:k]
    return [(seed, c, n, i) for i, (c, n) in enumerate(ranked, start=1)]


def smallest_shortest_path(adj, a, b, max_depth=4):
    """Level-wise walk over sorted paths; the first hit in order is the smallest."""
    paths, seen = {a: [a]}, {a}
    for depth in range(max_depth + 1):
        if b in paths:
            return paths[b]
        following = {}
        for node, path in paths.items():
            for other in adj[node]:
                if other not in seen:
                    candidate = path + [other]
                    following[other] = min(candidate, following.get(other, candidate))
        seen |= set(following)
        paths = following
    return None
