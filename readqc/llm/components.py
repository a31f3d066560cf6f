"""Connected components of a link table, by alternating large and small stars.

Each round is two group-bys with map-side minima and two joins on a node; a node with very many links is split by the
adaptive skew join. Rounds are written to the shared folder. Before the first round every partition replaces its links
by a spanning forest of them, which keeps all connections and bounds the links by nodes times partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.llm.common import Workspace


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x], x = root, p
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                parent.setdefault(min(ra, rb), min(ra, rb))
    nodes = [x for x in parent if find(x) != x]
    roots = [find(x) for x in nodes]
    for i in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 50_000], pa.int64()), pa.array(roots[i : i + 50_000], pa.int64())], names=["u", "v"])


def connected_components(links: DataFrame, ws: Workspace) -> DataFrame:
    """``links``: columns u, v (long, no nulls). Returns node, component (the smallest node reachable) for each node
    that has a link to another. Repeated links, links both ways and self links change nothing; no links give no rows."""
    edges = ws.stage(links.select("u", "v").mapInArrow(_forest, "u long, v long"), "forest")
    state, n = None, edges.count()
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = ws.stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars", rows=2 * n)
        ws.drop(edges)
        edges = found
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, n = now, now[0]
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
