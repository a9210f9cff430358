"""Answer records on small cases."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone.operators import answers


def test_retrieval_metrics(spark):
    asked = spark.createDataFrame(
        [(1, 0, answers.ANCHOR, True, [5, 6]), (1, 1, answers.TASK, True, [6, 7]), (1, 2, None, False, None), (2, 0, answers.ANCHOR, True, []), (3, 0, None, None, [9])],
        "question_id long, step int, name string, attempted boolean, titles array<long>",
    )
    gold = spark.createDataFrame([(1, [7, 5, 8, 7]), (2, [1]), (3, []), (4, [2])], "question_id long, gold_titles array<long>")
    got = {r.question_id: r for r in answers.retrieval_metrics(asked, gold, "question_id").collect()}
    one = got[1]
    assert one.gold_titles == [7, 5, 8] and one.titles == [5, 6, 7] and one.retrieved_gold == [7, 5] and one.incremental_gold == [7]
    assert (one.recall, one.anchor_recall, one.task_recall, one.incremental_recall) == pytest.approx((2 / 3, 1 / 3, 1 / 3, 1 / 3))
    assert (one.step_count, one.query_count, one.zero_result_count, one.task_query_count, one.firing_rate, one.followup_fired, one.all_gold) == (2, 2, 0, 1, 0.5, True, False)
    assert (got[2].recall, got[2].zero_result_count, got[2].task_recall, got[2].firing_rate) == (0.0, 1, None, 0.0)
    assert (got[3].recall, got[3].all_gold, got[3].anchor_recall, got[3].query_count) == (1.0, True, None, 0)
    assert (got[4].recall, got[4].titles, got[4].step_count) == (0.0, [], 0)


def test_evidence_metrics(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "question_id long, label long")
    questions = spark.createDataFrame([(1,), (2,), (3,)], "question_id long")
    got = {r.question_id: r for r in answers.evidence_metrics(pairs([(1, 1), (1, 2), (1, 2), (2, 4)]), pairs([(1, 2), (1, 3), (1, 4)]), questions, "question_id", "label").collect()}
    assert got[1][1:] == pytest.approx((1 / 2, 1 / 3, 2 / 5, 0.0)) and got[2][1:] == (0.0, 0.0, 0.0, 0.0) and got[3][1:] == (1.0, 1.0, 1.0, 1.0)


def test_with_scores(spark):
    made = spark.createDataFrame([Row(question_id=1, answer="The red mill"), Row(question_id=2, answer=None), Row(question_id=3, answer="x")])
    gold = spark.createDataFrame([(1, "red mill"), (2, "yes")], "question_id long, gold_answer string")
    got = answers.with_scores(made, gold, "question_id").orderBy("question_id").select(F.col("em"), F.col("f1")).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (0.0, 0.0), (None, None)]
