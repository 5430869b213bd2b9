"""Connected components of a table of links, by alternating stars.

Every node points its larger neighbours at the smallest node around it (large
star), then itself and its smaller neighbours (small star).  Both steps keep
components and flatten them until each is a star around its smallest node.
Groups are only ever reduced to a minimum, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairforge.session import stage


def _stars(edges: DataFrame, of: str, with_self: bool) -> DataFrame:
    """Join each edge (u, v) with the least neighbour of u; ``of`` keeps edges to smaller or to all nodes."""
    around = edges if of == "smaller" else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    if not with_self:  # large star: larger neighbours move to the least of node and neighbours
        moved = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # A node without larger neighbours keeps its edges through its own neighbours.
        return moved.distinct()
    moved = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).filter("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node), for every node that has a link.

    Links may repeat, run in either direction or join a node with itself; links
    with a null end are left out.  Every round is written to the shared folder.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = stage(links.filter(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").select(u.alias("u"), v.alias("v")).distinct())
    before = None
    while True:
        flat = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        now = edges.agg(F.count(F.lit(1)), flat).first()
        if now == before or not now[0]:
            break
        before = now
        edges = stage(_stars(_stars(edges, "all", False), "smaller", True))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
