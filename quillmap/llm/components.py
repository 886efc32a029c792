"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.traverse import connected


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of longs. One row per node that has an edge to another: node, component (its smallest node). Rounds grow with the logarithm of the nodes; see connected()."""
    return connected(edges.select("a", "b"))
