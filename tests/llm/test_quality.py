import math
import re

import regex
from pyspark.sql import functions as F

from zenithal.llm import quality

SF = "/root/testdata/sf0.001"


def test_rules_are_compiled_and_bounds_hold(spark):
    rows = [(i, ("GOOD words in a row. " * (i % 7 + 3)) if i % 2 else ("bad!! ### $$$ " * (i % 5 + 3)), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(df, df, trees=4, depth=2)
    assert model.rules
    out = quality.score(df, model).collect()
    assert all((r.score >= 0.5) == (r.label == 1) for r in out)
    assert all(0 <= r.score <= 1 for r in out)


def test_held_out_accuracy(spark):
    out = quality.op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    right = sum(r.predicted == r.quality for r in out)
    assert right >= 0.8 * len(out)


def test_one_label_no_rows_and_nulls(spark):
    schema = "doc_id long, text string, label int"
    none = spark.createDataFrame([], schema)
    empty = quality.fit(none, none)
    assert not empty.rules
    some = spark.createDataFrame([(1, "a", 1), (2, None, None)], schema)
    one = quality.fit(some, some)
    docs = spark.createDataFrame([(None, None, 0.5), (1, "", 0.1), (2, "x" * 100_000, 0.2)], "doc_id long, text string, score double")
    out = quality.score(docs, one)
    assert out.columns == ["doc_id", "text", "score"]
    assert all(r.score > 0.99 for r in out.collect())
    assert quality.score(docs.limit(0), one).count() == 0


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "some text", 7, 8)], "doc_id long, text string, upper int, y int")
    out = quality.score(docs, quality.RuleModel((), 0.0)).first()
    assert (out.upper, out.y, out.score) == (7, 8, 0.5)


def test_held_out_is_by_crc(spark):
    import zlib

    df = spark.range(200).withColumnRenamed("id", "doc_id")
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.withColumn("h", quality.held_out()).collect())
    assert df.where(F.lit(False)).withColumn("h", quality.held_out()).count() == 0


def plain_statistics(text):
    """The statistics of a text, without Spark."""
    t = text or ""
    words, lines = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w], [x for x in t.split("\n") if x.strip(" ")]
    chars, n, m = len(t), len(words), len(lines)
    share = lambda a, b: a / b if b else 0.0
    count = lambda p: len(regex.findall(p, t))
    blank = r"[ \t\n\x0b\f\r]"
    return {
        "log_words": math.log1p(n), "word_length": share(chars, n), "distinct_words": share(len(set(words)), n), "log_lines": math.log1p(m), "words_a_line": share(n, m), "distinct_lines": share(len(set(lines)), m),
        "upper": share(count(r"\p{Lu}"), chars), "digits": share(count("[0-9]"), chars), "marks": share(count("[!?]"), n), "pipes": share(t.count("|"), n), "symbols": share(sum(t.count(c) for c in "#$%&*<>{}[]=_~^\\"), n),
        "stops": share(count("[.,;:]"), n), "repeats": share(count(rf"(?<![^ \t\n\x0b\f\r])([^ \t\n\x0b\f\r]+) \1(?![^ \t\n\x0b\f\r])"), n), "short_words": share(sum(len(w) <= 3 for w in words), n),
        "junk_runs": share(count(rf"(?:(?!{blank})[^\p{{L}}\p{{N}}]){{3,}}"), n),
    }


def test_statistics_and_scores_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n \n"), (-4, "a a a b b| {x} ### ÄÖ ÜB 12 ...\n\nLine\nLine"), (-5, "Word! " * 20_000)], "doc_id long, text string")
    docs = docs.unionByName(odd)
    names = [n for n in quality.statistics(F.col("text"))]
    got = {r.doc_id: r.asDict() for r in docs.select("doc_id", "text", *[c.cast("double").alias(n) for n, c in quality.statistics(F.col("text")).items()]).collect()}
    assert set(names) - {"shouted"} == set(plain_statistics(""))
    for r in got.values():
        for n, x in plain_statistics(r["text"]).items():
            assert math.isclose(r[n], x, rel_tol=1e-9, abs_tol=1e-12), (r["doc_id"], n)
    # A model's score is the logistic function of the weights of the rules that hold.
    model = quality.fit_documents(spark, docs, SF)
    assert model.rules
    for r in quality.score(docs, model).collect():
        s = got[r.doc_id]
        z = model.intercept + sum(w for rule, w in model.rules if all(s[n] > x for n, x in rule.lower) and all(s[n] <= x for n, x in rule.upper))
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
