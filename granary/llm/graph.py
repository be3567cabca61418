"""Connected components by alternating star contraction (large star, then small star), all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import cut, parts, sized

#: A node is a hub from a share of 1 / (HUBS * partitions) of the edges on, so there are fewer than HUBS * partitions hubs.
HUBS, HUB_ROWS = 4, 64


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); the root is the least node that can be reached.

    Each round costs two aggregations and two joins on the edges that are left, and lineage is cut after each half. It
    stops once a round changes nothing: every edge then leads straight to its root. Hubs, whose edges would meet in one
    task, get their least neighbour from a broadcast of bounded length instead.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = _state(now)
    while seen[0]:
        now = sized(now, seen[0])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = cut(beside(now.select(F.col("v").alias("u"), F.col("u").alias("v")), least, seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = sized(large, seen[0])  # cut here too: the second half names it six times, and plans are held by the driver
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = beside(large, least, seen[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, seen = seen, _state(now)
        if seen == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def beside(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(u, v) with the ``m`` that ``least`` (u, m, n: the number of rows of u) has for u, of ``total`` rows at most; hubs come by
    broadcast, the rest by a shuffle."""
    most = max(HUB_ROWS, total // (HUBS * parts(rows.sparkSession)))
    hubs = F.broadcast(least.filter(F.col("n") > most).select("u", "m"))  # fewer than 2 * total / most
    usual = rows.join(hubs, "u", "left_anti").join(least.filter(F.col("n") <= most).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(usual)


def least_of_components(points: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """(key, component_id) for ``points`` (key, node, least): the smallest ``least`` of the node's component by ``edges`` (u, v), its
    own without edges. A component with a large share of all points doesn't meet in one task."""
    roots = components(edges).withColumnRenamed("node", "__node")
    linked = points.join(roots, points.node == F.col("__node"), "left").select(F.col(key).alias("v"), F.coalesce("root", "node").alias("u"), "least")
    linked = cut(linked)
    named = linked.groupBy("u").agg(F.min("least").alias("m"), F.count("*").alias("n"))
    return beside(linked.select("u", "v"), named, linked.count()).select(F.col("v").alias(key), F.col("m").alias("component_id"))


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
