"""Sketches by hour against exact ranks, and metrics observed beside a query."""

import bisect
import datetime
import random

import pytest
from pyspark.sql import functions as F

from zenithal.operators import metrics


@pytest.fixture(scope="module")
def values(spark):
    rng, start = random.Random(2), datetime.datetime(2024, 1, 1)
    rows = [("hot" if i % 10 else "cold", start + datetime.timedelta(minutes=i % 6000), rng.lognormvariate(2, 1.5)) for i in range(60_000)]
    return rows, spark.createDataFrame([*rows, ("hot", None, 1.0), ("hot", start, None), (None, start, 5.0)], "key string, at timestamp_ntz, v double").repartition(7)


def test_merged_sketches_stay_within_their_error(spark, values):
    rows, df = values
    kept = metrics.hourly(df, "key", "at", "v", 200)
    assert kept.count() > 150 and kept.agg(F.sum("n")).first()[0] == len(rows) + 1
    qs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    for r in metrics.quantiles(kept, qs).where("key is not null").collect():
        own = sorted(v for k, _, v in rows if k == r.key)
        assert r.n == len(own)
        for name, q in qs.items():
            assert abs(bisect.bisect_right(own, r[name]) / len(own) - q) <= 1.5 * metrics.rank_error(200)
    days = {(r.key, r.period): r for r in metrics.quantiles(kept, {"p50": 0.5}, F.col("hour").cast("date")).collect()}
    own = sorted(v for k, t, v in rows if k == "hot" and t.date() == datetime.date(2024, 1, 2))
    r = days["hot", datetime.date(2024, 1, 2)]
    assert r.n == len(own) and abs(bisect.bisect_right(own, r.p50) / len(own) - 0.5) <= 1.5 * metrics.rank_error(200)


def test_small_sets_are_exact(spark, values):
    df = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1, i % 24), float(i)) for i in range(1, 101)], "key string, at timestamp_ntz, v double")
    r = metrics.quantiles(metrics.hourly(df, "key", "at", "v", 200), {"p50": 0.5, "p95": 0.95, "p100": 1.0}).first()
    assert (r.n, r.p50, r.p95, r.p100) == (100, 50.0, 95.0, 100.0)


def test_metrics_beside_a_running_query(spark, values):
    rows, df = values
    seen_df, seen = metrics.observed(df, rows=F.count(F.lit(1)), worst=F.max("v"))
    out = seen_df.where("v > 100").count()
    assert seen.get["rows"] == len(rows) + 3 and seen.get["worst"] == max(v for *_, v in rows) and out == sum(v > 100 for *_, v in rows)


def test_loaders_by_content_and_path(spark, tmp_path):
    from zenithal.sources import documents, loaders

    texts = [("docx", "one\ntwo <&> three\n\nfour"), ("html", "a paragraph of more than twenty characters & more"), ("latex", "plain words\n\n\n\nand more")]
    rows = [(f"x/{k}.bin", loaders.WRITERS[k](t)) for k, t in texts] + [("x/what.bin", b"neither"), ("x/broken.docx", b"PK no archive"), ("x/none.html", None), ("x/By.HTML", b"<p>" + b"long enough to be kept " * 2)]
    got = {r.path: r for r in loaders.load(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert len(got) == len(rows)
    body = lambda p: [s.body for s in got[p].sections]
    assert (got["x/docx.bin"].loader, body("x/docx.bin")) == ("docx", ["one two <&> three four"])
    assert (got["x/html.bin"].loader, body("x/html.bin")) == ("html", [texts[1][1]])
    assert (got["x/latex.bin"].loader, body("x/latex.bin")) == ("latex", ["plain words\n\nand more"])
    assert got["x/By.HTML"].loader == "html" and got["x/By.HTML"].error is None
    assert got["x/what.bin"].error == got["x/none.html"].error == "no loader knows this file" and got["x/broken.docx"].error == "nothing could be read"
    mine = loaders.Loader("mine", lambda path, head: head.startswith("neither"), lambda f: f.select("path", F.array(F.struct(F.lit("h").alias("heading"), F.lit("b").alias("body"))).cast(documents.SECTIONS).alias("sections")))
    again = {r.path: r for r in loaders.load(spark.createDataFrame(rows, "path string, content binary"), [mine, *loaders.LOADERS]).collect()}
    assert again["x/what.bin"].content == "h\nb" and again["x/docx.bin"].loader == "docx"
