"""Communities of a graph by modularity: rounds of gain-driven moves, contraction of communities to nodes, level by level.

The graph is a table of both directions of every edge with weights, A(i, j); k(i) is a node's total, m2 the sum of all. Moving
node i into community c changes modularity by 2 (A(i, c) - k(i) tot(c) / m2) / m2, with tot(c) counted without i. In a round
half of the nodes, chosen by a hash of node and round, take the community of the largest gain; as the other half stands still,
two neighbours rarely change places for ever. The labels of the best round of a level are kept. A level ends when rounds no
longer gain; then communities become nodes (their inner edges a loop), and levels go on until one gains nothing.

All steps are joins and sums over edges: weights from a node to a community are added up in each task before they are shuffled,
so a hub costs rows and no task ever holds its neighbours. Rounds are written to the shared folder, which keeps lineage short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zenithal.session import discard, materialize


def weighted(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """(src, dst, w): both directions of every undirected edge, weights of repeated ones added up (1 each without ``weight``).
    Loops count once in each direction. Rows with a null end or weight are left out."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w")).dropna()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(graph: DataFrame, labels: DataFrame) -> float:
    """Of ``labels`` (id, community) over a graph as :func:`weighted` gives it; 0 for a graph without edges."""
    a, b = (labels.select(F.col("id").alias(end), F.col("community").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    e = graph.join(a, "src").join(b, "dst")
    per = e.groupBy("a").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inner"))
    r = per.agg(F.sum("tot").alias("m2"), F.sum("inner").alias("inner"), F.sum(F.col("tot") * F.col("tot")).alias("squares")).first()
    return r.inner / r.m2 - r.squares / r.m2**2 if r.m2 else 0.0


def _level(graph: DataFrame, m2: float, rounds: int, least: float, seed: int) -> tuple[DataFrame, float, bool]:
    """(labels (id, label), modularity, whether any node has moved) of one level, from every node on its own."""
    nodes = materialize(graph.groupBy("src").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("loop")).withColumnRenamed("src", "id"), "louvain-nodes")
    others = materialize(graph.where("src <> dst").join(nodes.select(F.col("id").alias("src"), "k"), "src"), "louvain-edges")
    labels, best, best_q, first, idle = nodes.withColumn("label", F.col("id")), None, None, None, 0
    none, old = F.lit(None).cast("double"), []
    for i in range(rounds + 1):
        total = labels.groupBy("label").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
        sized = labels.join(total, "label")
        near = others.join(sized.select(F.col("id").alias("dst"), "label", "tot", "size"), "dst").select(F.col("src").alias("id"), "label", "w", "k", "tot", "size", none.alias("loop"))
        rows = near.unionByName(sized.select("id", "label", F.lit(0.0).alias("w"), "k", "tot", "size", "loop"))
        to = rows.groupBy("id", "label").agg(F.sum("w").alias("near"), F.max("loop").alias("loop"), *[F.first(c).alias(c) for c in ("k", "tot", "size")])
        stays = F.col("loop").isNotNull()
        gain = F.round((F.col("near") - F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / m2) / m2, 15)
        best_of = lambda which: F.min(F.when(which, F.struct((-gain).alias("g"), "label")))  # noqa: B023, E731
        per = to.groupBy("id").agg(F.max(F.when(stays, F.struct("label", "k", "loop", "near", "tot", "size", gain.alias("gain")))).alias("own"), best_of(~stays & (F.col("size") > 1)).alias("many"), best_of(~stays & (F.col("size") == 1)).alias("single"))
        # Two single nodes may not change places: only the larger id goes to the smaller.
        single = F.when((F.col("own.size") > 1) | (F.col("single.label") < F.col("own.label")), F.col("single"))
        choice = F.least(F.col("many"), single)
        goal = F.when(-choice["g"] > F.col("own.gain"), choice["label"]).otherwise(F.col("own.label"))
        moved = materialize(per.select("id", F.col("own.label").alias("own"), "own.k", "own.loop", "own.tot", (F.col("own.near") + F.col("own.loop")).alias("inner"), goal.alias("to")), "louvain-moves")
        r = moved.groupBy("own").agg(F.sum("inner").alias("inner"), F.first("tot").alias("tot")).agg(F.sum("inner").alias("inner"), F.sum(F.col("tot") * F.col("tot")).alias("squares")).first()
        q = r.inner / m2 - r.squares / m2**2
        first = q if first is None else first
        idle = 0 if best is None or q > best_q + least else idle + 1
        if best is None or q > best_q:
            if best is not None:
                old.append(best)
            best, best_q = moved, q
        else:
            old.append(moved)
        while len(old) > 1:  # the last one may still be read by the next round
            discard(old.pop(0))
        if idle == 2 or i == rounds:  # both halves have had their turn
            break
        turn = F.pmod(F.xxhash64("id", F.lit(seed + i // 2)), F.lit(2)) == i % 2
        labels = moved.select("id", "k", "loop", F.when(turn, F.col("to")).otherwise(F.col("own")).alias("label"))
    return best.select("id", F.col("own").alias("label")), best_q, best_q > first


def louvain(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, rounds: int = 24, levels: int = 12, least: float = 4e-3) -> tuple[DataFrame, DataFrame]:
    """Members (id, community) and levels (level, communities, modularity) of an undirected graph.

    A community is named by the smallest id in it; an edge given in both directions, or twice, weighs twice. Every level's
    modularity is that of its communities over the whole graph, and is not below that of the level before. Nodes are those with an edge. An
    empty graph gives empty tables. ``rounds``, ``levels``: bounds of both loops; ``least``: what a round must gain to go on.
    The result is the same in every run as long as weights are whole numbers (their sums are exact then).
    """
    spark = edges.sparkSession
    graph = materialize(weighted(edges, src, dst, weight), "louvain-graph")
    m2 = graph.agg(F.sum("w")).first()[0]
    told: list[tuple[int, int, float]] = []
    members = graph.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct()
    current = graph
    for level in range(levels if m2 else 0):
        labels, q, gained = _level(current, m2, rounds, least, 1000 * level)
        if not gained:
            break
        members = materialize(members.join(labels.select(F.col("id").alias("community"), "label"), "community").select("id", F.col("label").alias("community")), "louvain-members")
        a, b = (labels.select(F.col("id").alias(end), F.col("label").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
        small = current.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        current = materialize(small, "louvain-graph")
        told.append((level, current.select("src").distinct().count(), float(q)))
    names = members.groupBy("community").agg(F.min("id").alias("name"))
    members = materialize(members.join(names, "community").select("id", F.col("name").alias("community")), "louvain-members")
    return members, spark.createDataFrame(told, "level int, communities long, modularity double")
