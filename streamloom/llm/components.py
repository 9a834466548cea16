"""Connected components of a table of links, without collecting links or labels anywhere.

Each round first contracts the links of every partition with union-find, then does one large-star and
one small-star step (Kiveris et al., 2014) as joins and aggregates. Rounds end when the links are a
forest of stars, which two sums over the table show. Neighbour minima are partial aggregates and hot
nodes are split by adaptive execution, so a node with a third of all links is no hazard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

#: Links held by one union-find before it emits its forest and starts anew.
CHUNK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (node, smallest node of its component) that the links (a, b) amount to."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out():
        u, v = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= CHUNK:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    Null ends and self-links count for nothing; repeated links and either direction are the same
    link. An empty table gives an empty table.
    """
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    links = links.where("u is not null and v is not null and u <> v")
    links = written(arrow_map(links, _contract, "u long, v long"), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = low.withColumnRenamed("m", "v").unionByName(down).where("u <> v").distinct()
        links = written(step, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
