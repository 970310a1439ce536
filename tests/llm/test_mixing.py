import re
from collections import Counter

from pyspark.sql import functions as F

from zenithal.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Target of each source by refilling until nobody is above the cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done = share * sum(sizes.values()), {}
    while True:
        left, free = total - sum(done.values()), [s for s in order if s not in done]
        if not free:
            return done
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: cap * sizes[s] for s in free if t[s] > cap * sizes[s] + 1e-9}
        if not over:
            return done | t
        done |= over


def check(rows, out):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in out:
        assert r.taken <= 2 * r.size and abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_targets_and_reruns(spark):
    rows = [(i, "word " * (i * 7 % 40), [None, "a", "b", "c", "d", "e"][min(i % 9, 5)]) for i in range(600)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    first = mixing.mix(df, bin_rows=20).collect()
    check(rows, first)
    assert len(first) == len(rows)
    again = mixing.mix(df.repartition(7), bin_rows=20).collect()
    assert sorted((r.key, r.taken) for r in first) == sorted((r.key, r.taken) for r in again)


def test_hot_source_ties_and_odd_rows(spark):
    rows = [(1, "a b", "hot")] * 300 + [(None, "x", "hot"), (2, None, "s"), (3, "", "s"), (4, "\t\n", None), (5, "w " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(rows, mixing.mix(df, bin_rows=50).collect())
    copies = mixing.mix_documents(df)
    assert copies.columns == df.columns
    want = sum(r.copies for r in mixing.mix(df).collect())
    assert copies.count() == want


def test_copies_of_equal_rows_and_odd_names(spark):
    rows = [(1, "a b", "hot", i) for i in range(7)] + [(2, "c", "s", 9), (None, "d e f", None, 10), (None, None, "s", 11)] + [(100 + i, "w " * i, "t", 12) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").select("doc_id", "text", "source", "n", *[F.lit(1).alias(c) for c in ("d", "h", "key", "row_hash", "_n", "copy", "total", "an.other")]).repartition(3)
    got = mixing.mix_documents(df)
    assert got.columns == df.columns
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.key, r.source, r.size] += r.copies
    have = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in got.collect())
    assert have == +want
    each = Counter(r.n for r in got.where("doc_id = 1").collect())
    assert max(each.values()) - min(each[i] for i in range(7)) <= 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mix_documents(df).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
