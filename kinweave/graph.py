"""The graph as two ordinary tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from kinweave.operators import edges as E


@dataclass(frozen=True)
class Graph:
    """Users and canonical edges (each friendship once, user_id < friend_id)."""

    users: DataFrame
    edges: DataFrame

    @classmethod
    def from_raw(cls, users: DataFrame, raw_edges: DataFrame) -> Graph:
        return cls(users, E.canonical_edges(raw_edges))

    @property
    def adj(self) -> DataFrame:
        """(src, dst) in both directions, unique because the edges are."""
        return E.neighbours(self.edges)

    @property
    def seeds(self) -> DataFrame:
        """Every user as a seed."""
        return self.users.select(self.users.user_id.alias("seed"))
