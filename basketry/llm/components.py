"""Connected components by alternating star contractions, staged so that lineage stays short."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import stage


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's links those that join two parts: fewer than its nodes, and they connect the same nodes."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up] if up in above else up
        return x

    for batch in batches:
        kept = []
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                above[max(a, b)] = min(a, b)
                kept.append((u, v))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id of an edge; component is the smallest id reachable.

    Every round keeps one row per remaining link and never gathers a node's neighbours: minima combine map-side.
    Self links and links with a null end are ignored; no edges give no rows.
    """
    links = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    # dense groups have many more links than nodes: each task drops what its other links imply, twice
    for _ in range(2):
        links = stage(links.mapInArrow(_forest, "u long, v long"), "links")
    while True:
        # large star: every larger neighbour of u moves to u's smallest neighbour
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = stage(small.distinct(), "links")
        # done when every node has one link, and that leads to a node that has none itself
        twice = after.groupBy("u").count().where("count > 1").limit(1).count()
        chained = 0 if twice else after.select(F.col("v").alias("u")).distinct().join(after, "u", "left_semi").limit(1).count()
        links = after
        if not twice and not chained:
            break
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
