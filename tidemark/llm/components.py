"""Connected components of a table of links, without collecting any of it.

Each partition first runs union-find over its own links and keeps a forest of
at most (nodes - 1) links; the forests are then contracted together by
alternating large-star and small-star steps, which turn every component into a
star around its smallest node in a few rounds. The hub of a star may have any
number of neighbours: joins on it are dealt over salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import salted_join


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x], x = root, p
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["u", "v"]
        )


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node that has a link to another; component is the smallest node reachable.

    ``links`` has two long columns; order, direction and repeats don't matter.
    """
    a, b = links.columns
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    edges = scratch.save(links.mapInArrow(_union_find, "u long, v long").where("u != v"), "forest")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("many"))
        low = scratch.save(low, "low")
        # large star: larger neighbours move to the smallest neighbour
        large = scratch.save(
            salted_join(both.where("v > u"), low, "u", "many", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large",
        )
        # small star: smaller neighbours and the node itself move there
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many")), "low")
        hop = salted_join(large, low, "u", "many", "v")
        small = hop.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        old, edges = edges, scratch.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(old, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
