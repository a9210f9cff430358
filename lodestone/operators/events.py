"""Retrieval events: what each step of a question asked and found, kept as one nested column of the step's record.

An event has a component for each query of the step: its name, query, whether it was attempted, and the titles it found. A
component that was attempted and found nothing keeps an empty list; a step that asks nothing, as an aggregate does, has an event
that was not attempted. Records from before events were kept have none; theirs are made of the step's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPONENT = T.StructType([
    T.StructField("place", T.LongType()), T.StructField("name", T.StringType()), T.StructField("query", T.StringType()), T.StructField("attempted", T.BooleanType()),
    T.StructField("titles", T.ArrayType(T.StringType())),
])
EVENT = T.StructType([T.StructField("attempted", T.BooleanType()), T.StructField("components", T.ArrayType(COMPONENT)), T.StructField("titles", T.ArrayType(T.StringType()))])

def _component(place: Column, name: Column, query: Column, attempted: Column, titles: Column) -> Column:
    """Null-safe: no name is an empty one, an unknown attempt is one if there is a query, and what wasn't attempted found nothing."""
    tried = F.coalesce(attempted, query.isNotNull())
    none = F.array().cast("array<string>")
    found = F.when(tried, F.coalesce(F.filter(titles.cast("array<string>"), lambda t: t.isNotNull()), none)).otherwise(none)
    return F.struct(place.cast("long").alias("place"), F.coalesce(name, F.lit("")).alias("name"), query.alias("query"), tried.alias("attempted"), found.alias("titles"))


def _event(components: Column) -> Column:
    """Components in order; titles of all of them, each where it comes first."""
    ordered = F.sort_array(components)
    return F.struct(F.exists(ordered, lambda c: c["attempted"]).alias("attempted"), ordered.alias("components"), F.array_distinct(F.flatten(F.transform(ordered, lambda c: c["titles"]))).alias("titles")).cast(EVENT)


def attached(steps: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """steps with event. asked: (keys..., place, name, query, attempted, titles), a row a query; a step's queries are few."""
    one = _component(*[F.col(c) for c in ("place", "name", "query", "attempted", "titles")])
    per = asked.groupBy(*keys).agg(_event(F.collect_list(one)).alias("event"))
    return rebuilt(steps.drop("event").join(per, keys, "left"))


def rebuilt(steps: DataFrame, name: str | None = None, query: str | None = None, titles: str | None = None) -> DataFrame:
    """steps, whose event is filled in where it or a part of it is absent: from the step's own query and titles, if columns
    of these are named and there is a query, else as not attempted. What is there stays."""
    whole = "event" in steps.columns
    own = _component(F.lit(0), F.col(name) if name else F.lit(None).cast("string"), F.col(query), F.lit(None).cast("boolean"), F.col(titles)) if query and titles else None
    none = F.array().cast(T.ArrayType(COMPONENT))
    made = none if own is None else F.when(F.col(query).isNotNull(), F.array(own.cast(COMPONENT))).otherwise(none)
    kept = F.transform(F.col("event.components"), lambda c: _component(c["place"], c["name"], c["query"], c["attempted"], c["titles"])) if whole else F.lit(None).cast(T.ArrayType(COMPONENT))
    return steps.withColumn("event", _event(F.coalesce(kept.cast(T.ArrayType(COMPONENT)), made)))


def listed(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., place, name, attempted, titles): a row for each component, for answers.retrieval_metrics; none for a step that
    asked nothing."""
    return steps.select(*keys, F.explode("event.components").alias("_c")).select(*keys, "_c.place", "_c.name", "_c.attempted", "_c.titles")
