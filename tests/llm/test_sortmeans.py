import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from zenithal.llm import sortmeans as S


def brute(rows, k, rounds, dims):
    """rows: (key, vector); the same by all distances in plain integers."""
    import math

    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    told = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    c = [v for _, v in sorted(kept, key=lambda r: (told(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for n in range(len(c)):
            if own := [v for (_, v), w in zip(kept, at, strict=True) if w == n]:
                c[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = [(i, *near(v)) for i, v in kept]
    per = {n: sum(d for _, d, m in got if m == n) for n in range(len(c))}
    return sorted(((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in got), key=repr)


def test_odd_vectors_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 256]) for i in range(300)]  # a small grid: many ties and equal vectors
    rows += [(7, rows[7][1])] * 2 + [(None, [0.5, 0.5, 0.5, 0.5]), (900, None), (901, [1.0, 2.0]), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "cluster": F.lit("x"), "key": F.lit(None)})
    got = S.cluster(df.repartition(5), k=9, rounds=3, dims=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 9, 3, 4)


@pytest.mark.parametrize("count", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, count):
    rows = [(i, [float(i), 0.0]) for i in range(count)]
    got = S.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=40, dims=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 40, 5, 2)


def test_very_large_components_stay_in_range(spark):
    rows = [(0, [1e30, -1e30]), (1, [0.0, 0.0]), (2, [1e30, 1e30])]
    got = S.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, dims=2).collect()
    assert len(got) == 3 and all(0 <= r.distance < 1 << 62 for r in got)


@pytest.mark.parametrize("size", [50, 1 << 25])
def test_scans_find_the_nearest_and_leave_centroids_out(size):
    rng = np.random.default_rng(1)
    c = np.concatenate([rng.integers(-size, size, (30, 8)), np.zeros((2, 8), np.int64)])  # two equal centroids: the smaller number wins
    v = np.concatenate([c[rng.integers(0, 32, 500)] + rng.integers(-2, 3, (500, 8)), (c[:10] + c[10:20]) // 2])
    want = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    before = rng.integers(0, 32, len(v))
    before[:400] = want[:400].argmin(axis=1)
    who, d, made = S.assign(v, before, S.Centroids.of(c))
    assert (who == want.argmin(axis=1)).all() and (d == want.min(axis=1)).all() and made < 0.6 * want.size
