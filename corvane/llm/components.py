"""Connected components of an edge table by repeated contraction.

Each round unites edges locally by union-find within a partition, takes every node's
smallest neighbour by a map-side combined minimum (no group is gathered), shortens the
resulting parent chains, and contracts the edges. Only edges between different trees go on,
so the table shrinks geometrically. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

FOREST_ROWS = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace edges by the union-find forest of each stretch of at most FOREST_ROWS edges."""
    parent: dict[int, int] = {}
    seen = 0

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def flush() -> pa.RecordBatch:
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= FOREST_ROWS:
            yield flush()
            parent.clear()
            seen = 0
    if parent:
        yield flush()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node id reachable, for every node that has an edge to another.

    Null ends and self-loops are ignored; repeated edges do no harm; no edges give no rows.
    """
    edges = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u is not null and v is not null and u <> v")
    edges = materialize(edges.mapInArrow(_forest, "u long, v long").filter("u <> v").distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        parent = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("up"))
        parent = materialize(parent, "parents")
        for _ in range(2):
            over = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = parent.join(over, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        parent = materialize(parent, "parents")
        maps.append(parent)
        a = parent.select(F.col("node").alias("u"), F.col("up").alias("a"))
        b = parent.select(F.col("node").alias("v"), F.col("up").alias("b"))
        edges = edges.join(a, "u").join(b, "v").filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        edges = materialize(edges, "edges")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = maps[0].select("node", F.col("up").alias("component"))
    for parent in maps[1:]:
        step = parent.select(F.col("node").alias("component"), F.col("up").alias("top"))
        out = out.join(step, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return out


def numpy_union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes; the plain form that tests compare with."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)])
