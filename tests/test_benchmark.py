"""Benchmark scoring with a callback: errors stay with their task, metrics and gates against plain numbers."""

import pytest

from zenithal.operators import benchmark

ROWS = [
    (1, "what is the period", "the period is 92 minutes", ["Period", "minutes"], [92.0]),
    (2, "bad question", "none", ["x"], [1.0]),
    (3, "how many", None, [], []),
    (4, None, "zero", None, [0.0, 10.0]),
]
SCHEMA = "task int, question string, expected string, entities array<string>, numbers array<double>"


def test_errors_stay_with_their_task_and_metrics_are_right(spark):
    def infer(questions):
        if any("bad" in q for q in questions):
            raise ValueError("cannot")
        return [f"The period is {90 + len(q) % 3} minutes 0" for q in questions]

    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    got = {r.task: r for r in benchmark.scored(benchmark.answered(df, infer)).collect()}
    assert got[2].error == "ValueError: cannot" and got[2].answer is None and got[2].overall_score is None
    one = got[1]
    assert (one.error, one.entity_recall, one.numeric_accuracy, one.answer_relevancy) == (None, 1.0, 1.0, 0.75) and one.faithfulness == 0.8
    assert one.overall_score == pytest.approx(0.35 + 0.25 + 0.2 * 0.8 + 0.2 * 0.75)
    assert (got[3].entity_recall, got[3].numeric_accuracy, got[3].faithfulness) == (1.0, 1.0, 1.0)
    assert got[4].numeric_accuracy == 0.5 and got[4].answer_relevancy == 1.0
    assert {r.error for r in benchmark.answered(df, lambda questions: []).collect()} == {"ValueError: 0 answers for 1 questions"}
    assert {r.answer for r in benchmark.answered(df).collect()} == {r[2] for r in ROWS}


def test_report_and_gates(spark):
    df = spark.createDataFrame([(g, e, s, s, s, s, s) for g, e, s in [("a", None, 0.9), ("a", None, 0.7), ("a", "x", None), ("b", None, 0.6), ("c", "x", None)]], "g string, error string, entity_recall double, numeric_accuracy double, faithfulness double, answer_relevancy double, overall_score double")
    got = {r.g: r for r in benchmark.report(df, "g").collect()}
    assert (got["a"].completed, got["a"].failed, got["a"].passed) == (2, 1, True) and got["a"].overall_score == pytest.approx(0.8)
    assert got["b"].failures == "entity_recall,numeric_accuracy,overall_score" and not got["b"].passed
    assert (got["c"].completed, got["c"].entity_recall, got["c"].passed) == (0, None, False)
