"""Graphs of nodes and edges, such as plans are: small, so that they are ordered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Edges that a graph may have; one with more is no plan, and refused.
EDGES = 100_000


def upstream_first(edges: DataFrame) -> list[tuple]:
    """(node, level, place) for edges (u, v): a level is the longest path from a node without a source. A cycle is an
    error that names a node of it."""
    rows = edges.limit(EDGES + 1).collect()
    if len(rows) > EDGES:
        raise ValueError(f"a graph of more than {EDGES} edges")
    after: dict = {}
    waits: dict = {}
    for u, v in {(r[0], r[1]) for r in rows}:
        after.setdefault(u, []).append(v)
        waits[v] = waits.get(v, 0) + 1
        waits.setdefault(u, 0)
    level = {n: 0 for n, k in waits.items() if not k}
    open_ = list(level)
    while open_:
        u = open_.pop()
        for v in after.get(u, []):
            level[v] = max(level.get(v, 0), level[u] + 1)
            waits[v] -= 1
            if not waits[v]:
                open_.append(v)
    stuck = [n for n, k in waits.items() if k]
    if stuck:
        raise ValueError(f"a cycle through {min(stuck)}")
    return [(n, k, i + 1) for i, (k, n) in enumerate(sorted((k, n) for n, k in level.items()))]
