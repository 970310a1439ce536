"""Connected components over an edge table, by alternating large-star and small-star steps.

Each step is two aggregations and two joins on node ids; no neighbour list is ever collected, so a node with very many
edges costs rows, not memory. Every round is written to the shared folder, so lineage stays short and lost executors
only repeat the current round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zenithal.session import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v; returns edges of the same kind."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node that has an edge; component is the smallest node reachable.

    Loops and repeated edges are allowed; an empty table gives an empty result. Nodes without edges are not returned:
    they are their own component.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    cur = materialize(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    # A sum of keyed hashes tells whether a round has changed the edge set.
    state = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = state(cur)
    while seen[0]:
        nxt = materialize(_star(_star(cur, True), False), "cc")
        now = state(nxt)
        discard(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
