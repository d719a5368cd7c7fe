"""Connected components of a link table by alternating star contractions, all in DataFrame operations.

Every round points each node's larger neighbours at the smallest one it sees, first over all neighbours,
then over the smaller ones; a chain of n links needs about log n rounds.  Each round's links are written
to the shared scratch folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import stored


def _point_at_smallest(links: DataFrame, larger: bool) -> DataFrame:
    """One contraction of (u, v) links, u > v: the links of each node go to the smallest node it sees."""
    if larger:
        seen = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = links
    low = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = seen.join(low, "u")
    if larger:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link: the smallest node of its component.

    ``links`` has two long columns, u and v, in any order and with any repeats.
    """
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    e = stored(e, "links")
    mark = None
    while True:
        e = stored(_point_at_smallest(_point_at_smallest(e, True), False), "links")
        # Equal sums of hashes twice running: the links have not changed.
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    # Every link now goes from a node to the smallest of its component.
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
