"""Connected components of a link table, by union-find and star contraction.

Each task first joins its own links with a union-find, which leaves one star for
each local component. Stars of different tasks are then contracted in rounds:
every node hands its larger neighbours to the least one around it, then its
smaller ones. Rounds go on until the links no longer change, about log of the
longest path. All of it stays in tables; the driver sees two numbers a round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verilake.sources.scratch import cut


def _local_stars(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x] = root
            x = up
        return root

    def stars():
        found = [(x, find(x)) for x in parent]
        found = [(x, r) for x, r in found if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > 500_000:
            yield stars()
    yield stars()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (u long, v long) that is not its own root.

    The root is the smallest node that can be reached. Links may repeat, come in
    either direction, and join a node with itself; links with a null are dropped.
    """
    links = links.select("u", "v").filter(F.col("u") != F.col("v"))
    links = cut(links.mapInArrow(_local_stars, "u long, v long").distinct())
    before = None
    while True:
        links = cut(_small_star(_large_star(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
