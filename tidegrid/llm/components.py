"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node hangs its larger (or smaller) neighbours on its least neighbour.

    ``edges`` has one row (u, v) with u > v per link.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(links: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node id that each linked node reaches.

    Links are undirected; self links and links with a null end are ignored;
    repeated links count once; no links give an empty table. Nodes without a
    link are not in the result. Each round is two shuffles of the links by
    node; rounds grow with the logarithm of the longest path. The least id
    joins back to a hub's links by a join whose skewed side Spark can split.
    """
    edges = (
        links.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
        .checkpoint()
    )
    before = None
    for _ in range(max_rounds):
        edges = _star(_star(edges, large=True), large=False).checkpoint()
        # A forest of stars repeats itself; two independent sums tell that nothing moved.
        now = edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")),
        ).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
