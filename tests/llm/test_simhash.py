import numpy as np
import pytest
import xxhash

from zenithal.llm import simhash
from zenithal.llm.components import connected_components


def plain_fingerprint(text, shingle=4):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > n)


def brute(rows, radius=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for c, (k, _) in zip(comp, rows, strict=True):
        if k is not None:
            least[c] = min(k, least.get(c, k))
    return sorted([(k, f, least.get(c)) for (k, _), f, c in zip(rows, fps, comp, strict=True)], key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int").repartition(4)
    return sorted([(r.key, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(df).collect()], key=str)


@pytest.mark.parametrize("text", ["", None, " \t", "One", "a b c d", "A B C D e f g a b c d", "É x É y \x0b z \x1c w", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = [vocabulary[j] for j in rng.integers(0, 400, 300)]
        rows.append((3 * i + 5, " ".join(words)))
        for c in range(i % 3):
            copy = list(words)
            for _ in range(c):
                copy[rng.integers(0, 300)] = "changed"
            rows.append((3 * i + 6 + c, " ".join(copy)))
    rows += [(1000, ""), (1001, None), (900, "  "), (None, rows[0][1]), (2000, "long " * 40_000), (2001, "long " * 40_000), (2000, "long " * 40_000)]
    assert run(spark, rows) == brute(rows)
    for size in (2, 16):
        monkeypatch.setattr(simhash.link_forest, "__defaults__", (4, 4, size, 64))
        assert run(spark, rows) == brute(rows)


def test_links_at_every_distance(spark):
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 2**63))
    fps = [base]
    for d in range(1, 9):
        x = base
        for b in rng.choice(64, d, replace=False).tolist():
            x ^= 1 << b
        fps.append(x)
    fps += [int(x) for x in rng.integers(0, 2**63, 200)]
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    for shard_rows, leaf_rows in ((4096, 2048), (4096, 8), (2, 64), (2, 8)):
        links = connected_components(simhash.link_forest(df, 4, shard_rows, leaf_rows)).collect()
        root = {r.node: r.component for r in links}
        for i, x in enumerate(fps):
            for y in fps[:i]:
                if (x ^ y).bit_count() <= 4:
                    s = lambda v: v - 2**64 if v >= 2**63 else v
                    assert root[s(x)] == root[s(y)]


def signed(v):
    return v - 2**64 if v >= 2**63 else v


@pytest.mark.parametrize("runs", [5, 6, 8, 9])
def test_masks_leave_one_differing_bit(runs):
    found, rng = simhash.masks(runs), np.random.default_rng(3)
    for _ in range(3000):
        spread = int(rng.integers(1, 65))
        bits = sum(1 << int(b) for b in rng.choice(spread, min(4, spread), replace=False))
        assert min((bits & m).bit_count() for m in found) <= simhash.SLACK
    assert simhash.runs_for(1000) == 5 and simhash.runs_for(10**9) == 6 and 8 <= simhash.runs_for(5 * 10**10) <= 9


@pytest.mark.parametrize("clustered", [False, True])
def test_trees_prune_and_overlap(clustered):
    """Every pair within the slack meets in a leaf, most other leaves are pruned, and the overlap is what finds some pairs."""
    rng = np.random.default_rng(4)
    mask = simhash.masks(5)[0]
    fps = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    if clustered:
        fps[2000:] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64))
    near = fps ^ np.array([1 << b for b in rng.choice([b for b in range(64) if mask >> b & 1], len(fps)).tolist()], np.uint64)
    tree = simhash.Tree.fit(fps[:1500], mask, 9)  # the lower levels have keyed points
    row, leaf, side = tree.route(np.concatenate([fps, near]))
    home = dict(zip(row[side == 0].tolist(), leaf[side == 0].tolist(), strict=True))
    assert len(home) == 2 * len(fps)
    asks = set(zip(row[side == 1].tolist(), leaf[side == 1].tolist(), strict=True))
    n, crossed = len(fps), 0
    for i in range(n):
        together = home[i] == home[i + n]
        crossed += not together
        assert together or (i, home[i + n]) in asks or (i + n, home[i]) in asks
    assert crossed > n // 10
    assert len(row) / (2 * n) < 2**9 / 20


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 600 + i) for i in range(100)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[600 + i] == 500 for i in range(100))
