"""Nested buckets: covers and joins against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from zenithal.operators import intervals


def test_a_cover_is_exact_and_small(spark):
    cases = [(a, b) for a in range(0, 40, 3) for b in range(a - 1, 64, 5)]
    rows = spark.createDataFrame([(a, b) for a, b in cases], "a long, b long").select("a", "b", intervals.cover(F.col("a"), F.col("b"), 8).alias("c")).collect()
    for r in rows:
        held = [x for c in r.c for x in range(c.bucket << c.level, (c.bucket + 1) << c.level)]
        assert sorted(held) == list(range(r.a, r.b + 1)) and len(r.c) <= 12


@pytest.mark.parametrize("seed", range(2))
def test_join_and_counts_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    spans = [(i, rng.choice("xy"), rng.choice([None, rng.randrange(-50, 400)]), rng.choice([None, rng.randrange(0, 900)])) for i in range(120)] + [(500, "x", 7, 7), (501, "y", 9, 3), (502, "z", 5000, None), (503, "z", None, -900)]
    points = [(rng.randrange(-100, 600),) for _ in range(80)] + [(7,), (7,), (None,)]
    a = spark.createDataFrame(spans, "id long, kind string, first int, last int")
    b = spark.createDataFrame(points, "day int")
    holds = lambda s, p: (s[2] is None or s[2] <= p) and (s[3] is None or s[3] >= p)
    got = intervals.holding(a, b, "first", "last", "day").select("day", "id").collect()
    assert sorted(map(tuple, got)) == sorted((p, s[0]) for (p,) in points if p is not None for s in spans if holds(s, p))
    got = intervals.counts_at(a, b, "first", "last", "day", ["kind"]).collect()
    want = {(p, k): n for p in {p for (p,) in points if p is not None} for k in "xyz" if (n := sum(holds(s, p) for s in spans if s[1] == k))}
    assert {(r.day, r.kind): r.n for r in got} == want and len(got) == len(want)


def test_no_points_and_no_intervals(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], "id long, first int, last int"), spark.createDataFrame([], "day int")
    assert intervals.holding(a, b, "first", "last", "day").count() == 0 == intervals.counts_at(a, b, "first", "last", "day", ["id"]).count()
    assert intervals.holding(a.limit(0), spark.createDataFrame([(1,)], "day int"), "first", "last", "day").count() == 0


def test_a_long_interval_is_not_copied_to_each_day(spark):
    a = spark.createDataFrame([(1, 0, None), (2, None, None)], "id long, first int, last int")
    assert intervals._covered(a, "first", "last", 0, 17).count() <= 40
