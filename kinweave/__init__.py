"""kinweave: social-graph and measurement analytics as Spark DataFrame programs."""

from kinweave.graph import Graph

__all__ = ["Graph"]
