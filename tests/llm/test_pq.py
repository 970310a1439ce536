import numpy as np
import pytest

from zenithal.llm import pq


def brute(rows, cosine=0.9):
    """(id, links, component) by comparing every pair in double precision."""
    good = {}
    for i, (k, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= cosine:
                links[i].add(j)
    out = []
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((k, len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n_links string").repartition(3)
    return sorted([(r.key, r.n_links, r.component) for r in pq.similar(df, **kw).collect()], key=str)


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dims))
    near = base[rng.integers(0, len(base), n - len(base))] + 0.25 * rng.normal(size=(n - len(base), dims))
    return [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(np.concatenate([base, near]))]


@pytest.mark.parametrize("least_rows", [2048, 50])
def test_against_all_pairs(spark, least_rows):
    """As one block, and with an index."""
    rows = vectors(300, 16, 1)
    assert run(spark, rows, least_rows=least_rows) == brute(rows)


@pytest.mark.parametrize("least_rows", [2048, 50])
def test_hot_blocks_are_cut_into_cells(spark, monkeypatch, least_rows):
    monkeypatch.setattr(pq, "BLOCK_ROWS", 40)
    rows = vectors(200, 8, 2)
    assert run(spark, rows, cell_values=8 * 16, least_rows=least_rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.1]), (10, [1.0]), (11, [3e38, 1e20])]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (5, 0, 5) in got and (3, 0, 3) in got


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pq.similar(df).count() == 0


def near(cosine, a, way):
    """Unit vectors at this cosine from ``a``, each in its direction ``way``."""
    a = a / np.linalg.norm(a, axis=1, keepdims=True)
    way = way - (way * a).sum(1, keepdims=True) * a
    return a, cosine[:, None] * a + np.sqrt(1 - cosine[:, None] ** 2) * way / np.linalg.norm(way, axis=1, keepdims=True)


def found(spark, x, **kw):
    """Links of each row and the root of each row, through Spark."""
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(4)
    got = pq.similar(df, **kw).toPandas().set_index("key").sort_index()
    return got.n_links.to_numpy(), got.component.to_numpy()


@pytest.mark.parametrize("dims,rank", [(64, 64), (64, 8), (64, 4), (384, 16)])
def test_recall_near_the_threshold(spark, dims, rank):
    """Pairs at cosine 0.9001 to 0.92, in directions of the data's own rank, through Spark with the lists that n asks for."""
    rng = np.random.default_rng(3)
    n = 2500
    base = rng.normal(size=(rank, dims)) if rank < dims else np.eye(dims)
    a, b = near(rng.uniform(0.9001, 0.92, n), rng.normal(size=(n, rank)) @ base, rng.normal(size=(n, rank)) @ base)
    x = np.concatenate([a, b]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(unit[i : i + 500] @ unit.T >= 0.9).sum(1) - 1 for i in range(0, 2 * n, 500)])
    links, _ = found(spark, x)
    assert (links <= want).all() and links.sum() >= 0.99 * want.sum()


def test_vectors_of_other_lengths_change_nothing(spark):
    rng = np.random.default_rng(5)
    a, b = near(np.full(1500, 0.92), rng.normal(size=(1500, 64)), rng.normal(size=(1500, 64)))
    rows = [[float(v) for v in r] for r in np.concatenate([a, b])]
    more = [[1.0] * 2048, [0.5] * 2048, [2.0], [3.0], [1.0] * 100_000, []]
    kind = "vec_id long, embedding array<float>"
    alone = {r.key: (r.n_links, r.component) for r in pq.similar(spark.createDataFrame(list(enumerate(rows)), kind)).collect()}
    mixed = {r.key: (r.n_links, r.component) for r in pq.similar(spark.createDataFrame(list(enumerate(rows + more)), kind)).collect()}
    assert {k: mixed[k] for k in alone} == alone and sum(n for n, _ in alone.values()) >= 0.99 * 3000
    assert [mixed[3000 + i] for i in range(6)] == [(1, 3000), (1, 3000), (1, 3002), (1, 3002), (0, 3004), (0, 3005)]


def test_a_common_vector_and_clashing_names(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(1000, [1.0, 2.01]), (1001, [-1.0, 0.5])]
    df = spark.createDataFrame([(k, v, [1], 2, 3) for k, v in rows], "`the.key` long, `v` array<float>, key array<int>, copies int, cid int").repartition(5)
    got = {r.key: (r.n_links, r.component) for r in pq.similar(df, "the.key", "v").collect()}
    assert all(got[i] == (500, 0) for i in [*range(500), 1000]) and got[1001] == (0, 1001)


def test_no_pair_of_low_rank_vectors_is_missed(spark):
    """Vectors of four effective dimensions in 64, few enough to be compared as one block."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(4, 64))
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(rng.normal(size=(700, 4)) @ base + 1e-3 * rng.normal(size=(700, 64)))]
    assert run(spark, rows) == brute(rows)
