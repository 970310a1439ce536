"""Scoring a model over a table of tasks: an inference callback in batches, metrics of each answer, a report with quality gates.

The callback gets a list of questions and gives as many answers; it runs in Arrow batches beside the data, so a model is loaded
where tasks are. A batch that fails is asked again question by question: only a task whose own question fails has an error."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zenithal.functions import text as T
from zenithal.session import ship

#: Weights of the metrics in the overall score, and what their means must reach.
WEIGHTS = {"entity_recall": 0.35, "numeric_accuracy": 0.25, "faithfulness": 0.20, "answer_relevancy": 0.20}
GATES = {"entity_recall": 0.70, "numeric_accuracy": 0.80, "overall_score": 0.65}


def _each(infer: Callable[[list[str]], list[str]], questions: list[str]) -> list[dict]:
    try:
        answers = infer(questions)
        if len(answers) != len(questions):
            raise ValueError(f"{len(answers)} answers for {len(questions)} questions")
        return [{"answer": a, "error": None} for a in answers]
    except Exception as e:  # noqa: BLE001 - an error is a result here
        if len(questions) == 1:
            return [{"answer": None, "error": f"{type(e).__name__}: {e}"}]
        return [x for q in questions for x in _each(infer, [q])]


def answered(tasks: DataFrame, infer: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """``tasks`` (question, expected, ...) plus ``answer`` and ``error``. Without a callback the expected answer stands in (a dry run)."""
    if infer is None:
        return tasks.withColumn("answer", F.col("expected")).withColumn("error", F.lit(None).cast("string"))
    ship(tasks.sparkSession)
    kind = pa.struct([("answer", pa.string()), ("error", pa.string())])

    @F.arrow_udf("struct<answer:string,error:string>")
    def ask(questions: pa.Array) -> pa.Array:
        return pa.array(_each(infer, [q or "" for q in questions.to_pylist()]), kind)

    return tasks.withColumn("_a", ask("question")).select(*tasks.columns, "_a.answer", "_a.error")


def _found(keys: Column, answer: Column) -> Column:
    hit = F.filter(keys, lambda k: F.contains(F.lower(answer), F.lower(k)))
    return F.when(F.coalesce(F.size(keys), F.lit(0)) <= 0, 1.0).otherwise(F.size(hit) / F.size(keys))


def _numbers(expected: Column, answer: Column) -> Column:
    theirs = T.numbers(answer)
    near = lambda g: F.exists(theirs, lambda a: F.when(g == 0, a == 0).otherwise(F.abs(a - g) / (F.abs(g) + 1e-12) <= 0.10))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, 1.0).otherwise(F.size(F.filter(expected, near)) / F.size(expected))


def scored(tasks: DataFrame) -> DataFrame:
    """``tasks`` (question, expected, entities, numbers, answer, error) plus the four metrics and their weighted sum; null where
    there is an error."""
    answer = F.coalesce("answer", F.lit(""))
    metrics = {"entity_recall": _found(F.col("entities"), answer), "numeric_accuracy": _numbers(F.col("numbers"), answer), "faithfulness": T.overlap(F.col("expected"), answer), "answer_relevancy": T.overlap(F.col("question"), answer)}
    rows = tasks.select("*", *[F.when(F.col("error").isNull(), m).alias(n) for n, m in metrics.items()])
    return rows.withColumn("overall_score", functools.reduce(operator.add, [w * F.col(n) for n, w in WEIGHTS.items()]))


def report(rows: DataFrame, *groups: str) -> DataFrame:
    """(*groups, completed, failed, means of the metrics, failures, passed) over scored tasks; ``failures``: gates not reached."""
    mean = lambda n: F.avg(F.col(n).cast("decimal(20,12)")).cast("double").alias(n)
    out = rows.groupBy(*groups).agg(F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"), *[mean(n) for n in (*WEIGHTS, "overall_score")])
    missed = F.array_compact(F.array(*[F.when(F.coalesce(F.col(n), F.lit(0.0)) < least, F.lit(n)) for n, least in GATES.items()]))
    return out.withColumn("failures", F.array_join(missed, ",")).withColumn("passed", F.col("failures") == "")
