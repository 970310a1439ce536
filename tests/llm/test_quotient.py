import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zenithal.llm import quotient as Q


def brute(rows):
    norm = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    groups = {}
    for (k, _), x in zip(rows, norm, strict=True):
        groups.setdefault(x, []).append(k)
    least = {x: min(ks, key=lambda k: (k is None, k or 0)) for x, ks in groups.items()}
    seen, out = set(), []
    for (k, _), x in zip(rows, norm, strict=True):
        first = k == least[x] and x not in seen
        if first:
            seen.add(x)
        out.append((k, least[x], len(groups[x]), first, hashlib.sha256(x.encode()).hexdigest()))
    return Counter(out)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a\x0b\x0c\r\n b"), (4, "a\xa0b"), (6, "a b "), (7, None), (8, ""), (2, "   "), (1, "é" * 50_000), (11, "é" * 50_000), (12, "é" * 49_999 + "e"), (3, "a b"), (None, "a b"), (None, "n"), (None, "n"), (20, "x"), (20, "x")] + [(100 + i, "copy " * 3) for i in range(400)]


@pytest.mark.parametrize("bits,map_bits", [(64, 24), (9, 4), (16, 16)])
def test_equal_to_plain_python_whatever_the_fingerprint(spark, bits, map_bits):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"key": F.lit(1), "fingerprint": F.lit("x"), "text_sha256": F.lit(None)})
    got = Q.exact_groups(df.repartition(7), bits=bits, map_bits=map_bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(ROWS)


def test_an_empty_table(spark):
    assert Q.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("bits,q", [(10, 3), (10, 10), (48, None), (64, 5)])
def test_filters_merge_without_loss(bits, q):
    rng = np.random.default_rng(bits)
    high = (1 << bits) - 1
    parts = [rng.integers(0, min(high, 900), 500).astype(np.uint64) for _ in range(3)] + [np.array([high, high, 0, 3], np.uint64), np.zeros(0, np.uint64)]
    made = [Q.QuotientFilter.from_bytes(Q.QuotientFilter.build(p, bits=bits, q=q).to_bytes()) for p in parts]
    merged = Q.QuotientFilter.from_bytes(Q.QuotientFilter.merge(made).to_bytes())
    want = Counter(np.concatenate(parts).tolist())
    v, n = merged.items()
    assert dict(zip(v.tolist(), n.tolist(), strict=True)) == dict(want) and v.tolist() == sorted(want)
    assert all(merged.count(x) == want[x] for x in [*range(min(high, 950)), high])
    whole = Q.QuotientFilter.build(np.concatenate(parts), bits=bits)
    assert whole.to_bytes() == Q.QuotientFilter.merge(made).to_bytes()


def test_merged_shards_count_every_fingerprint(spark):
    values = [int(x) for x in np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 800)] * 2 + [7] * 1000 + [-1, 0]
    rows = spark.createDataFrame([(v,) for v in values], "f long").repartition(6)
    filters, shard_bits = Q.build_filters(rows, 64, shard_rows=50)
    got = Q.counts_of(filters, 64, shard_bits).collect()
    assert Counter({r.fingerprint: r.n for r in got}) == Counter(values) and len(got) == len(set(values))


def test_only_texts_that_may_repeat_are_moved(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(5000, "text 7")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = df.select("text", F.col("doc_id").alias("key"), F.xxhash64("text").alias("fingerprint"))
    filters, shard_bits = Q.build_filters(marked.select("fingerprint"))
    found = Q.repeated_map(Q.counts_of(filters, 64, shard_bits, 2), 24)
    assert sorted(r.key for r in Q._routed(marked, found, 24).collect()) == [7, 5000]
