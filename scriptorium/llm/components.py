"""Connected components of a link table, as joins and aggregations.

Large-star and small-star steps alternate until the links are stars.  Minima are aggregated
before they are joined back, so a hub of any degree is one partial sum per task, and in the joins the links of
hubs are dealt to salted keys.  Each round is written to the shared folder, which bounds the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .common import join_salted


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an undirected link table; root is the least node reachable.

    Links from a node to itself and repeated links change nothing; null ends are ignored.
    """
    u, v = F.col("u"), F.col("v")
    edges = stage(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    mark = _mark(edges)
    while True:
        # large star: every greater neighbour is linked to the least of the neighbourhood
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
        large = stage(join_salted(both.where(v > u), least, ["u"], "n", v).select(v.alias("u"), F.col("m").alias("v")).distinct(), "large_star")
        # small star: the lesser neighbours and the node itself are linked to the least of them
        lesser = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "lesser")
        small = join_salted(large, lesser, ["u"], "n", v)
        step = small.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).unionByName(lesser.select("u", F.col("m").alias("v")))
        edges = stage(step.distinct(), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(u.alias("node"), v.alias("root")).unionByName(edges.select(v.alias("node"), v.alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free sum: equal for equal link tables."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
