"""Connected components of an edge table; every round is a written table.

Defined cases: an edge from a node to itself, repeated edges and an empty table are fine; nodes without an edge are not in
the result; edges with a null end are left out. Raises if the rounds do not suffice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from trendloom import stars
from trendloom.llm.common import stash


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u, v: long) -> node, component (the smallest node it reaches), for nodes that have an edge."""
    return stars.connected_components(edges, lambda e: stash(e, "edges"), rounds)
