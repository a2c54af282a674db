"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(u, v), longs; the component is its smallest node.

    Links, minima and components stay distributed; each round is written to the shared folder,
    so lineage stays short. A hub with many links is only ever aggregated or joined, never
    gathered. Null ends and loops are ignored; an empty table has no components.
    """
    ends = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = saved(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined: a join of two plain shuffles can be split where a hub is hot
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = saved(both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        was, mark = mark, _mark(after)
        forget(edges, low, large, least)
        edges = after
        if mark == was:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
