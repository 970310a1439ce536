"""Property graphs as node and edge tables: hops, paths, lineages, centrality, communities.

Walks keep a frontier of (start, node) pairs that are made distinct in every step, so a hub is joined once for each start,
and steps are written to the shared folder, so lineage stays short. No neighbour list is ever gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zenithal.session import discard, materialize, tasks_of


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reachable(edges: DataFrame, starts: DataFrame, hops: int, directed: bool = True) -> DataFrame:
    """(start, node, hops): every node that is reached in 1 to ``hops`` steps, with the least number of steps; the start
    itself only if ``directed`` and a cycle leads back, with that number."""
    steps = edges.select("src", "dst").distinct() if directed else undirected(edges)
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    seen: DataFrame | None = None
    for i in range(1, hops + 1):
        found = frontier.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        if not directed:
            found = found.where("start <> node")
        if seen is not None:
            found = found.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = materialize(found.withColumn("hops", F.lit(i)), "reach")
        seen = frontier if seen is None else seen.unionByName(frontier)
    return seen


def shared_neighbours(edges: DataFrame, part_rows: int = 500) -> DataFrame:
    """(id, other): all ordered pairs of different nodes with an edge to the same node, each once.

    The members of a hub meet in parts of about ``part_rows``. A pair can repeat only if both of its nodes have several
    neighbours, so only such pairs are made distinct; all others are neither shuffled nor held."""
    n = tasks_of(edges.sparkSession)
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    parts = e.groupBy("dst").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("dst", F.ceil(F.col("_m") / part_rows).alias("_n"))
    single = e.groupBy("src").agg((F.count(F.lit(1)) == 1).alias("_one"))
    rows = materialize(e.join(single, "src").join(parts, "dst"), "shared-neighbours")
    a = rows.select("dst", F.pmod(F.xxhash64("src"), "_n").alias("_s"), F.col("src").alias("id"), "_one")
    b = rows.select("dst", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_s"), F.col("src").alias("other"), "_one")

    def met(where_a: str, where_b: str) -> DataFrame:
        left, right = (d.where(w).drop("_one").repartition(n, "dst", "_s") for d, w in ((a, where_a), (b, where_b)))
        return left.join(right, ["dst", "_s"]).where("id <> other").select("id", "other")

    return met("_one", "true").unionByName(met("not _one", "_one")).unionByName(met("not _one", "not _one").distinct())


def shortest_paths(edges: DataFrame, starts: DataFrame, hops: int = 6) -> DataFrame:
    """(start, node, hops, path) over undirected edges; of the shortest paths the one whose last step comes from the least
    node, and so on back. Breadth first: a step only keeps pairs that were not there before."""
    steps = undirected(edges)
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path")).distinct()
    seen = materialize(frontier.withColumn("hops", F.lit(0)), "paths")
    frontier = seen
    for i in range(1, hops + 1):
        found = frontier.select("start", "node", "path").join(steps, F.col("node") == F.col("src"))
        best = found.groupBy("start", F.col("dst").alias("next")).agg(F.min(F.struct("node", "path")).alias("b"))
        best = best.join(seen.select("start", F.col("node").alias("next")), ["start", "next"], "left_anti")
        frontier = materialize(best.select("start", F.col("next").alias("node"), F.array_append("b.path", F.col("next")).alias("path"), F.lit(i).alias("hops")), "paths")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def lineages(edges: DataFrame, depth: int = 10) -> DataFrame:
    """(root, terminal, generations, path) for nodes of chains in which each has at most one successor: from every node to
    where its chain ends, at most ``depth`` steps away."""
    step = edges.select("src", "dst")
    cur = step.select(F.col("src").alias("root"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"), F.lit(1).alias("generations"))
    done: DataFrame | None = None
    for i in range(1, depth + 1):
        nxt = cur.join(step, F.col("at") == F.col("src"), "left")
        ended = nxt.where("dst is null").select("root", F.col("at").alias("terminal"), "generations", "path")
        done = ended if done is None else done.unionByName(ended)
        if i == depth:
            break
        cur = materialize(nxt.where("dst is not null").select("root", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), F.lit(i + 1).alias("generations")), "lineage")
    return done


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, rank) over undirected edges by a fixed number of rounds; ranks sum up to the number of nodes. Every node has an
    edge here, so none is a dead end."""
    both = materialize(undirected(edges, src, dst), "rank-edges")
    degree = materialize(both.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "rank-degree")
    ranks = degree.select(F.col("src").alias("id"), F.lit(1.0).alias("rank"))
    for _ in range(rounds):
        share = ranks.join(degree, F.col("id") == F.col("src")).select("id", (F.col("rank") / F.col("degree")).alias("share"))
        got = both.join(share, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum("share").alias("got"))
        old, ranks = ranks, materialize(got.select(F.col("dst").alias("id"), (1 - damping + damping * F.col("got")).alias("rank")), "rank")
        discard(old)
    return ranks


def communities(edges: DataFrame, rounds: int = 10, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, community) by label propagation: in each round a node takes the label that most neighbours have (its own counts
    as one; ties go to the least). A stand-in for modularity optimisation, which has no fixed-size rounds."""
    both = materialize(undirected(edges, src, dst), "label-edges")
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "label").unionByName(labels.select("id", "label"))
        counts = votes.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))
        old, labels = labels, materialize(best, "labels")
        discard(old)
    return labels.withColumnRenamed("label", "community")


def neighbours(edges: DataFrame, node: str, direction: str = "both", types: list[str] | None = None, at: Column | None = None) -> DataFrame:
    """The edges of one node with ``other`` (the far end): out, in or both ways; of some types; valid at a time."""
    out, into = edges.where(F.col("src") == node).withColumn("other", F.col("dst")), edges.where(F.col("dst") == node).withColumn("other", F.col("src"))
    found = {"out": out, "in": into}.get(direction) if direction != "both" else out.unionByName(into)
    if types is not None:
        found = found.where(F.col("type").isin(types))
    if at is not None:
        from zenithal.operators.filters import valid_at

        found = found.where(valid_at(at, F.col("since"), F.col("until")))
    return found


def chain(edges: DataFrame, *types: str) -> DataFrame:
    """Rows (n0, n1, ...) of paths whose edges have the given types, one after the other; ``^type`` goes against an edge."""
    rows = None
    for i, t in enumerate(types):
        a, b = (f"n{i + 1}", f"n{i}") if t.startswith("^") else (f"n{i}", f"n{i + 1}")
        step = edges.where(F.col("type") == t.lstrip("^")).select(F.col("src").alias(a), F.col("dst").alias(b))
        rows = step if rows is None else rows.join(step, f"n{i}")
    return rows.select(*[f"n{i}" for i in range(len(types) + 1)])


#: Named subgraphs: labels of nodes and types of edges.
PROJECTIONS = {
    "organisational": (["Organization", "Country"], ["SUBSIDIARY_OF", "HEADQUARTERED_IN"]),
    "registry": (["Satellite", "Country", "Region"], ["REGISTERED_IN", "LOCATED_IN"]),
}


def project(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The edges of a named subgraph: of its types, both ends of its labels."""
    labels, types = PROJECTIONS[name]
    ids = nodes.where(F.col("label").isin(labels)).select("id")
    kept = edges.where(F.col("type").isin(types))
    return kept.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
