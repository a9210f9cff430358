"""Retrieval events: orders are questions, their return flags steps, and lineitems the queries of a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events
from .registry import query, read
from .source_queries import _folder

_KEYS = ["question_id", "step"]

#: A line of few pieces asked nothing; one of a great discount found nothing; every order has an aggregate step besides.
_EVENTS = """
WITH c AS (SELECT l_orderkey AS question_id, l_returnflag AS step, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey::VARCHAR) AS place, l_discount < 0.09 AS hit, (l_partkey % 50)::VARCHAR AS title FROM lineitem WHERE l_quantity >= 10),
s AS (SELECT DISTINCT l_orderkey AS question_id, l_returnflag AS step FROM lineitem UNION SELECT o_orderkey, 'aggregate' FROM orders),
t AS (SELECT question_id, step, title, min(place) AS place FROM c WHERE hit GROUP BY ALL)
SELECT s.question_id, s.step, (SELECT count(*) FROM c WHERE c.question_id = s.question_id AND c.step = s.step) > 0 AS attempted,
  (SELECT count(*) FROM c WHERE c.question_id = s.question_id AND c.step = s.step) AS n_asked,
  (SELECT count(*) FROM c WHERE c.question_id = s.question_id AND c.step = s.step AND NOT hit) AS n_empty,
  coalesce((SELECT string_agg(title, ',' ORDER BY place) FROM t WHERE t.question_id = s.question_id AND t.step = s.step), '') AS titles
FROM s"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("step"), "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    aggregate = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.lit("aggregate").alias("step"))
    found = F.when(F.col("l_discount") < 0.09, F.array((F.col("l_partkey") % 50).cast("string"))).otherwise(F.array().cast("array<string>"))
    asked = items.select(*_KEYS, F.col("l_linenumber").alias("place"), F.lit("part").alias("name"), F.col("l_partkey").cast("string").alias("query"), (F.col("l_quantity") >= 10).alias("attempted"), found.alias("titles"))
    return items.select(*_KEYS).distinct().unionByName(aggregate), asked


def _told(steps: DataFrame) -> DataFrame:
    tried = F.filter("event.components", lambda c: c["attempted"])
    return steps.select(*_KEYS, F.col("event.attempted").alias("attempted"), F.size(tried).cast("long").alias("n_asked"), F.size(F.filter(tried, lambda c: F.size(c["titles"]) == 0)).cast("long").alias("n_empty"), F.array_join("event.titles", ",").alias("titles"))


@query(_EVENTS)
def events_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events made of the queries of each step."""
    return _told(events.attached(*_tables(spark, sf_dir), _KEYS))


@query(_EVENTS)
def events_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after they were written as JSON Lines, which leaves out what is null, and read again; steps that asked
    nothing are written without an event."""
    path = f"{_folder(spark)}/steps"
    made = events.attached(*_tables(spark, sf_dir), _KEYS)
    bare = made.withColumn("event", F.when(F.size("event.components") > 0, F.col("event")))
    bare.write.json(path)
    return _told(events.rebuilt(spark.read.schema(made.schema).json(path)))
