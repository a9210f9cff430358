"""Retrieval events: made, persisted without nulls, rebuilt where they are absent."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers, events

KEYS = ["q", "step"]


@pytest.fixture
def tables(spark):
    steps = spark.createDataFrame([("q", 0, "first", ["a"]), ("q", 1, None, None), ("r", 0, "other", []), ("r", 1, None, None)], "q string, step long, query string, titles array<string>")
    asked = spark.createDataFrame(
        [("q", 0, 2, answers.TASK, "second", True, ["b", "a"]), ("q", 0, 1, answers.ANCHOR, "first", True, ["a", None]), ("q", 1, 0, answers.TASK, "held back", False, ["x"]), ("r", 0, 0, answers.ANCHOR, "other", None, None)],
        "q string, step long, place long, name string, query string, attempted boolean, titles array<string>",
    )
    return steps, asked


def told(df):
    return {(r.q, r.step): (r.event.attempted, [(c.place, c.name, c.attempted, c.titles) for c in r.event.components], r.event.titles) for r in df.collect()}


WANT = {
    ("q", 0): (True, [(1, answers.ANCHOR, True, ["a"]), (2, answers.TASK, True, ["b", "a"])], ["a", "b"]),
    ("q", 1): (False, [(0, answers.TASK, False, [])], []),  # not attempted, so it found nothing
    ("r", 0): (True, [(0, answers.ANCHOR, True, [])], []),  # asked, and nothing found: kept
    ("r", 1): (False, [], []),
}


def test_events_of_steps(tables):
    assert told(events.attached(*tables, KEYS)) == WANT


def test_events_survive_a_log_that_leaves_out_nulls(spark, tables, tmp_path):
    made = events.attached(*tables, KEYS)
    made.withColumn("event", F.when(F.size("event.components") > 0, F.col("event"))).write.json(str(tmp_path / "log"))
    back = spark.read.schema(made.schema).json(str(tmp_path / "log"))
    assert back.where("event is null").count() == 1
    assert told(events.rebuilt(back)) == WANT
    assert told(events.rebuilt(events.rebuilt(back))) == WANT


def test_old_records_get_their_event_from_their_own_columns(tables):
    steps, asked = tables
    own = events.rebuilt(steps, query="query", titles="titles")
    assert told(own) == {("q", 0): (True, [(0, "", True, ["a"])], ["a"]), ("q", 1): (False, [], []), ("r", 0): (True, [(0, "", True, [])], []), ("r", 1): (False, [], [])}
    mixed = events.attached(steps.where("q = 'q'"), asked, KEYS).unionByName(steps.where("q = 'r'"), allowMissingColumns=True)
    got = told(events.rebuilt(mixed, query="query", titles="titles"))
    assert got["q", 0] == WANT["q", 0] and got["r", 0] == (True, [(0, "", True, [])], [])
    assert events.rebuilt(steps.where("false")).count() == 0


def test_metrics_of_listed_events(spark, tables):
    rows = events.listed(events.attached(*tables, KEYS), KEYS)
    gold = spark.createDataFrame([("q", ["b", "z"]), ("r", ["a"])], "q string, gold_titles array<string>")
    got = {r.q: r for r in answers.retrieval_metrics(rows, gold, "q").collect()}
    assert (got["q"].recall, got["q"].query_count, got["q"].incremental_recall, got["q"].anchor_recall) == (0.5, 2, 0.5, 0.0)
    assert (got["r"].recall, got["r"].query_count, got["r"].zero_result_count) == (0.0, 1, 1)
