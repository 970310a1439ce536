"""Centroid clustering by sort-means, in exact integers.

Each round orders, for every centroid, the others by their distance from it. A vector starts from the centroid it was assigned
to the round before, at distance d, and scans the others in that centroid's order. By the triangle inequality a centroid that is
further than 2 d from the current one is further than d from the vector, so the scan stops strictly beyond 2 d: at 2 d exactly
the two may tie, and the smaller number wins. All distances are squared integers, so D(a, j) > 2 d is D^2 > 4 d^2, without
rounding.

A round is one pass: tasks read vectors with their assignments, write them with the new ones, and add one row for each
centroid with the count, the sum and the inertia of its vectors. The new centroids come from these partial rows only (at most
``k`` rows from each task, read without the vectors), so no vector is shuffled, and however many equal or close ones there are,
none of them meet in one task. What is sent around is k centroids and their k * k distances.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.session import discard, materialize, ship

#: Components are held within +-LARGEST, so squared distances over 64 of them are below 2**62 and sums are exact.
LARGEST = 1 << 27
#: Up to this absolute value products of 64 components are exact in doubles, where matrix products are faster.
EXACT = 1 << 22


@dataclass(frozen=True)
class Centroids:
    """The centroids (k rows), and for each the numbers of all in order of their squared distance from it, and that distance."""

    rows: np.ndarray
    order: np.ndarray
    apart: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Centroids:
        rows = rows.astype(np.int64)
        gap = np.array([((rows - r) ** 2).sum(axis=1) for r in rows]).reshape(len(rows), len(rows))
        gap[np.arange(len(rows)), np.arange(len(rows))] = -1  # itself first, also before its equals
        order = np.argsort(gap, axis=1, kind="stable")
        return cls(rows, order, np.maximum(np.take_along_axis(gap, order, axis=1), 0))


def _squares(v: np.ndarray, c: np.ndarray, own: np.ndarray | None, small: bool) -> np.ndarray:
    """Squared distances of the rows ``v`` from one centroid ``c``; ``own``: the rows' squared lengths (of small values)."""
    if small:
        return (own - 2 * (v @ c.astype(np.float64)) + float(c @ c)).astype(np.int64)
    return ((v - c) ** 2).sum(axis=1)


def assign(v: np.ndarray, before: np.ndarray, model: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances computed): the nearest centroid of each row of ``v``, of equally near ones that of
    the smaller number; ``before``: the numbers to scan from."""
    small = len(v) > 0 and max(np.abs(v).max(), np.abs(model.rows).max(initial=0)) <= EXACT
    v = v.astype(np.float64 if small else np.int64)
    length = (v * v).sum(axis=1) if small else None
    best, least, made = before.astype(np.int64), np.zeros(len(v), np.int64), 0
    for a in np.unique(before):
        at = np.nonzero(before == a)[0]
        current = _squares(v[at], model.rows[a], length[at] if small else None, small)
        reach = np.searchsorted(model.apart[a], 4 * current, "right")  # so many of the order are within twice the distance
        by = np.argsort(-reach, kind="stable")
        at, reach, current = at[by], reach[by], current[by]
        own, own_length, who = v[at], length[at] if small else None, np.full(len(at), a, np.int64)
        made += len(at)
        for place in range(1, int(reach[0])):
            n = int(np.searchsorted(-reach, -place, "left"))  # rows whose scan goes as far as this
            c = int(model.order[a, place])
            d = _squares(own[:n], model.rows[c], own_length[:n] if small else None, small)
            made += n
            nearer = (d < current[:n]) | ((d == current[:n]) & (c < who[:n]))
            current[:n][nearer], who[:n][nearer] = d[nearer], c
        best[at], least[at] = who, current
    return best, least, made


def integers(embedding: Column, scale: int = 256) -> Column:
    """Each component as floor(scale * x), x as double; within +-LARGEST."""
    low, high = F.lit(float(-LARGEST)), F.lit(float(LARGEST))
    return F.transform(embedding, lambda x: F.floor(F.least(F.greatest(F.lit(scale) * x.cast("double"), low), high)).cast("int"))


def usable(embedding: Column, dims: int) -> Column:
    """True for vectors of exactly ``dims`` components, none null or non-finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(embedding) == dims) & ~F.exists(embedding, bad), F.lit(False))


_ROW = "key {kind}, v array<int>, cluster int, distance long, n long, sums array<long>, inertia decimal(38,0)"


def _pass(rows: DataFrame, model: Centroids, first: bool) -> DataFrame:
    """``rows`` (key, v, cluster) assigned anew, and after them one row for each cluster and task: (cluster, n, sums, inertia).

    Written once and read twice: with ``n is null`` the vectors, without it the partial sums."""
    kind, dims = rows.schema["key"].dataType.simpleString(), model.rows.shape[1]

    def run(batches):
        k = len(model.rows)
        n, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k
        schema = None
        for b in batches:
            v = b.column(1).flatten().to_numpy().reshape(-1, dims)
            before = np.zeros(len(v), np.int64) if first else b.column(2).to_numpy()
            who, d, _ = assign(v, before, model)
            by = np.argsort(who, kind="stable")
            ids, starts = np.unique(who[by], return_index=True)
            for c, s, e in zip(ids.tolist(), starts.tolist(), [*starts[1:].tolist(), len(by)], strict=True):
                n[c] += e - s
                sums[c] += v[by[s:e]].sum(axis=0, dtype=np.int64)
                inertia[c] += sum(map(int, d[by[s:e]])) if d.max() > 1 << 40 else int(d[by[s:e]].sum())
            none = lambda t, m: pa.nulls(m, t)
            schema = pa.schema([("key", b.schema.field(0).type), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("inertia", pa.decimal128(38, 0))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(schema.field("v").type), pa.array(who.astype(np.int32)), pa.array(d), *[none(schema.field(x).type, len(v)) for x in ("n", "sums", "inertia")]], schema=schema)
        some = np.nonzero(n)[0]
        if len(some):
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, dims * len(some) + 1, dims), pa.int32()), pa.array(sums[some].ravel()))
            yield pa.RecordBatch.from_arrays([*[none(schema.field(x).type, len(some)) for x in ("key", "v")], pa.array(some.astype(np.int32)), none(pa.int64(), len(some)), pa.array(n[some]), parts, pa.array([inertia[c] for c in some.tolist()], pa.decimal128(38, 0))], schema=schema)

    return materialize(rows.select("key", "v", "cluster").mapInArrow(run, _ROW.format(kind=kind)), "sortmeans")


def _moved(done: DataFrame, model: Centroids) -> Centroids:
    """Every centroid that has vectors becomes their componentwise floor(sum / count); the others stay."""
    parts = done.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    sums = parts.groupBy("cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rows = model.rows.copy()
    for r in sums.collect():  # k * dims rows at most
        rows[r.cluster, r.at] = r.s // r.n
    return Centroids.of(rows)


def fit(vectors: DataFrame, starts: np.ndarray, rounds: int = 5) -> tuple[Centroids, DataFrame]:
    """``vectors`` (key, v array<int> of the starts' length) after ``rounds`` rounds from the centroids ``starts``.

    Returns the last centroids and the written table of the assignment to them: rows of vectors (key, v, cluster, distance) and
    partial rows (see :func:`_pass`). Keys may be null or repeat; every row is a vector of its own."""
    ship(vectors.sparkSession)
    model = Centroids.of(starts)
    done, first = vectors.withColumn("cluster", F.lit(0)), True
    for i in range(rounds + 1):
        old, done = done, _pass(done if first else done.where("n is null"), model, first)
        discard(old)
        first = False
        if i < rounds:
            model = _moved(done, model)
    return model, done


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, key: str = "vec_id", embedding: str = "embedding", dims: int = 64, seed: str = "2") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector of ``rows``.

    Starts are the ``k`` vectors whose ``seed:key`` has the smallest SHA-256, in that order. Vectors of another length, null
    ones, and those with null or non-finite components are left out. Rows with a null key come last among the starts; rows
    that repeat are vectors of their own, and rows of one key stand in the order of their components. Of equally near
    centroids the smaller number is taken. Components beyond +-2**27 after scaling count as that. ``inertia`` (over a cluster
    or all) is null if it is no long. Fewer vectors than ``k`` give as many centroids; an empty table gives an empty result.
    Other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    got = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{embedding}`").alias("e")).where(usable(F.col("e"), dims)).select("key", integers(F.col("e")).alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    starts = got.select("v", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    kind = rows.schema[key].dataType.simpleString()
    if not starts:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    model, done = fit(got, np.array([s.v for s in starts], np.int64), rounds)
    parts = done.where("n is not null").groupBy("cluster").agg(F.sum("inertia").cast("decimal(38,0)").alias("i")).collect()  # k rows at most
    per = {r.cluster: int(r.i) for r in parts}
    total, fits = sum(per.values()), lambda x: x if x < 1 << 63 else None
    told = [(c, fits(i), fits(total), hashlib.sha256(",".join(map(str, model.rows[c].tolist())).encode()).hexdigest()) for c, i in per.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = done.where("n is null").select("key", "cluster", "distance").join(F.broadcast(told), "cluster")
    return found.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors of ``embeddings`` in 40 clusters after 5 rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 40, rounds: int = 5) -> str:
    near = "SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(n, d * 1000 + n) AS cluster, min(d) AS d FROM (SELECT v.vec_id, v.rid, v.v, c.n, CAST(list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i} c) x GROUP BY rid"
    steps = [
        "v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS n, v AS c FROM (SELECT v, sha256('2:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        steps.append(f"s{i} AS (SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM a{i}) GROUP BY 1, 2)")
        steps.append(f"m{i} AS (SELECT cluster, list((s - ((s % m) + m) % m) // m ORDER BY pos) AS c FROM s{i} GROUP BY 1)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT n, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.n)")
    steps.append(f"a AS MATERIALIZED ({near.format(i=rounds)})")
    out = "SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256"
    return f"WITH {', '.join(steps)} {out} FROM a JOIN c{rounds} c ON c.n = a.cluster"


ORACLE_SQL = _sql()
