"""Certificates of batches: what a plan expects against what was recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digests
from .registry import query, read

#: Expected: events in the order of their ids; actual: in the order of their times, those without a value left out.
_BOTH = """
WITH a AS (SELECT event_type AS stage, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) AS i, user_id, value FROM events),
b AS (SELECT event_type AS stage, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) AS i, user_id, value FROM events WHERE value < 150),
j AS (SELECT coalesce(a.stage, b.stage) AS stage, coalesce(a.i, b.i) AS i, a.stage IS NOT NULL AS in_a, b.stage IS NOT NULL AS in_b, a.stage IS NULL OR b.stage IS NULL OR a.user_id IS DISTINCT FROM b.user_id OR a.value IS DISTINCT FROM b.value AS differs
  FROM a FULL JOIN b ON a.stage = b.stage AND a.i = b.i)"""


def _compared(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events = read(spark, sf_dir, "events")
    expected = digests.leaves(events, "event_type", ["event_id"], ["user_id", "value"])
    actual = digests.leaves(events.where("value < 150"), "event_type", ["ts", "event_id"], ["user_id", "value"])
    return digests.compare(expected, actual, ["user_id", "value"])


@query(
    _BOTH
    + """ SELECT stage, (i // 32)::BIGINT AS batch_no, count(*) FILTER (in_a) AS n_expected, count(*) FILTER (in_b) AS n_actual, count(*) FILTER (differs) AS n_places FROM j GROUP BY ALL HAVING bool_or(differs)"""
)
def batch_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose digests differ between the plan and the record, and in how many places."""
    return _compared(spark, sf_dir)["batches"]


@query(
    _BOTH
    + """ SELECT stage, CASE WHEN NOT in_b THEN 'missing' WHEN NOT in_a THEN 'unexpected' ELSE 'different' END AS status, count(*) AS n FROM j WHERE differs GROUP BY ALL"""
)
def record_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of differing batches by what is wrong with them."""
    return _compared(spark, sf_dir)["records"].groupBy("stage", "status").agg(F.count("*").alias("n"))
