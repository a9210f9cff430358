"""Checks in one pass, orders of ids, deltas, and calls by what they are for."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import invariants


def test_rows_and_groups_are_checked_at_once(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, -1.0), ("b", 2, None), (None, 3, 5.0)], "g string, k long, v double")
    got = invariants.checked(df, {"negative": F.col("v") < 0, "null": F.col("v").isNull()}, ["g"], {"repeated": F.count_distinct("k") < F.count("*"), "unsure": F.min("v") < 0})
    assert {r.name: (r.violations, r.ok) for r in got.collect()} == {"negative": (1, False), "null": (1, False), "repeated": (1, False), "unsure": (1, False)}
    assert {r.violations for r in invariants.checked(df.where("false"), {"x": F.lit(True)}, ["g"], {"y": F.lit(True)}).collect()} == {0}
    assert invariants.checked(df, {"none": F.lit(None).cast("boolean")}).first().ok
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1  # the table is read once
    for bad in ({}, {"repeated": F.lit(True)}):
        with pytest.raises(ValueError, match="check"):
            invariants.checked(df, bad, ["g"], {"repeated": F.lit(True)} if bad else None)


def test_orders_are_compared_by_place(spark):
    a = spark.createDataFrame([(k, i) for i, k in enumerate("abcd")], "k string, i long").repartition(3)
    b = spark.createDataFrame([(k, i) for i, k in enumerate("acb")], "k string, i long")
    got = sorted(map(tuple, invariants.order_differences(a, b, "k", ["i"], ["i"]).collect()))
    assert got == [(1, "b", "c"), (2, "c", "b"), (3, "d", None)]
    assert invariants.order_differences(a, a, "k", ["i"], ["i"]).count() == 0
    assert invariants.order_differences(a.where("false"), b, "k", ["i"], ["i"]).count() == 3


def test_deltas_of_a_gate(spark):
    runs = spark.createDataFrame([("base", 1.0, 5.0), ("x", 0.5, None), ("y", 1.0, 6.0)], "run string, a double, b double")
    got = {(r.run, r.metric): (r.delta, r.passed) for r in invariants.deltas(runs, "run", "base", {"a": -0.1, "b": 0.0}).collect()}
    assert got == {("x", "a"): (-0.5, False), ("x", "b"): (None, False), ("y", "a"): (0.0, True), ("y", "b"): (1.0, True)}


STAGES = [("s0", "define", 0, "step_definer"), ("s1", "define", 1, "step_definer"), ("end", "plan_summary", 0, "plan_summary")]


def calls(spark, rows):
    made = spark.createDataFrame(rows, "q string, stage string, role string, strict string, effective string, route string")
    return invariants.conceptual(made, spark.createDataFrame(STAGES, "stage string, concept string, step int, role string"), ["q"])


def test_calls_are_indexed_by_what_they_are_for(spark):
    rows = [("q", "s0", "step_definer", "x", "x", "parsed"), ("q", "s1", "step_definer", None, "y", "salvaged"), ("q", "end", "plan_summary", "z", "z", "parsed")]
    assert sorted((r.concept, r.step, r.effective) for r in calls(spark, rows).collect()) == [("define", 0, "x"), ("define", 1, "y")]
    for bad, what in (([("q", "s9", "step_definer", None, None, None)], "no such stage"), ([("q", "s0", "qa", None, None, None)], "another role"), ([rows[0], rows[0]], "met twice")):
        with pytest.raises(Exception, match=what):
            calls(spark, bad).collect()


def test_churn_of_strict_and_effective_payloads(spark):
    a = calls(spark, [("q", "s0", "step_definer", "x", "x", "parsed"), ("r", "s0", "step_definer", "x", "x", "parsed"), ("s", "s0", "step_definer", None, "u", "salvaged"), ("only", "s0", "step_definer", "x", "x", "parsed")])
    b = calls(spark, [("q", "s0", "step_definer", "y", "y", "parsed"), ("r", "s0", "step_definer", None, "x", "salvaged"), ("s", "s0", "step_definer", None, "v", "fallback")])
    r = invariants.churn(a, b, ["q"]).first()
    assert tuple(r) == ("define", 4, 3, 3, 1, 1, 2, 2)
