"""Queries over services (P): ground tracks, passes, screening, generic table calls, benchmark scoring."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zenithal.operators import benchmark, screening
from zenithal.plans.registry import query
from zenithal.queries.b_propagation import latest_sets


def _sets(t):
    return latest_sets(t).select("name", "line1", "line2")


def _first_words(questions: list[str]) -> list[str]:
    """A model for tests: the first nine words of a question and a number; it can't answer questions of some lengths."""
    if any(len(q) % 17 == 0 for q in questions):
        raise ValueError("no answer")
    return [" ".join([*q.split()[:9], "42"]) for q in questions]


_SETW = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> ''))"
_SHARE = "CASE WHEN len({0}) = 0 THEN 1e0 ELSE len(list_intersect({0}, {1})) / len({0}) END"


@query("p3_benchmark_scoring", rf"""
WITH x AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
y AS (SELECT conv_id % 3 AS category, q, a, length(q) % 17 = 0 AS failed, array_to_string(list_concat(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '')[1:9], ['42']), ' ') AS g FROM x WHERE a IS NOT NULL AND q IS NOT NULL),
m AS (SELECT category, failed, CAST((CAST(contains(lower(g), 'the') AS INTEGER) + CAST(contains(lower(g), 'and') AS INTEGER)) / 2e0 AS DOUBLE) AS e, 0.5e0 AS n, {_SHARE.format(_SETW.format('a'), _SETW.format('g'))} AS f, {_SHARE.format(_SETW.format('q'), _SETW.format('g'))} AS r FROM y),
k AS (SELECT category, failed, CASE WHEN NOT failed THEN e END AS e, CASE WHEN NOT failed THEN n END AS n, CASE WHEN NOT failed THEN f END AS f, CASE WHEN NOT failed THEN r END AS r FROM m),
t AS (SELECT category, count(*) FILTER (NOT failed) AS completed, count(*) FILTER (failed) AS failed, avg(e) AS entity_recall, avg(n) AS numeric_accuracy, avg(f) AS faithfulness, avg(r) AS answer_relevancy, avg(0.35e0 * e + 0.25e0 * n + 0.2e0 * f + 0.2e0 * r) AS overall_score FROM k GROUP BY 1),
u AS (SELECT *, concat_ws(',', CASE WHEN coalesce(entity_recall, 0) < 0.7 THEN 'entity_recall' END, CASE WHEN coalesce(numeric_accuracy, 0) < 0.8 THEN 'numeric_accuracy' END, CASE WHEN coalesce(overall_score, 0) < 0.65 THEN 'overall_score' END) AS failures FROM t)
SELECT category, completed, failed, round(entity_recall, 6) AS entity_recall, round(numeric_accuracy, 6) AS numeric_accuracy, round(faithfulness, 6) AS faithfulness, round(answer_relevancy, 6) AS answer_relevancy, round(overall_score, 6) AS overall_score, failures, failures = '' AS passed FROM u""")
def p3(t):
    """Turns of conversations as questions, what follows as the expected answer, answered by a callback: a report for each category."""
    nxt = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    tasks = t.conversations.select((F.col("conv_id") % 3).alias("category"), F.col("text").alias("question"), nxt.alias("expected")).where("expected is not null and question is not null")
    tasks = tasks.withColumn("entities", F.array(F.lit("the"), F.lit("AND"))).withColumn("numbers", F.array(F.lit(41.0), F.lit(100.0)))
    out = benchmark.report(benchmark.scored(benchmark.answered(tasks, _first_words)), "category")
    return out.select("category", "completed", "failed", *[F.round(n, 6).alias(n) for n in (*benchmark.WEIGHTS, "overall_score")], "failures", "passed")


@query("p8_ground_track")
def p8_track(t):
    out = screening.ground_track(_sets(t), screening.epochs(t.spark, "2024-06-01 00:00:00", 10, 60))
    return out.select("norad_id", "epoch", *[F.round(c, 5).alias(c) for c in ("lat_deg", "lon_deg", "alt_km")])


@query("p8_passes")
def p8_passes(t):
    out = screening.passes(_sets(t), screening.epochs(t.spark, "2024-06-01 00:00:00", 721, 60), 48.1, 11.6, 0.5)
    return out.withColumn("max_elevation", F.round("max_elevation", 5))


@query("p8_screening")
def p8_screening(t):
    """Pairs within 3000 km at the start, as the synthetic objects are far apart."""
    out = screening.screen(_sets(t), "2024-06-01 00:00:00", distance_km=3000.0)
    return out.select("id_a", "id_b", "tca", F.round("distance", 5).alias("distance"), F.round("speed_kms", 6).alias("speed_kms"), F.round("pc", 10).alias("pc"), "risk")


@query("p9_generic_table", "SELECT norad_id, name FROM catalog WHERE norad_id <> 5 ORDER BY name, norad_id LIMIT 100 OFFSET 10")
def p9(t):
    table = screening.Table(t.catalog.select("norad_id", "name"), "norad_id")
    return screening.Table(table.delete(5), "norad_id").list(order="name", limit=100, offset=10)
