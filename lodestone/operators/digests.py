"""Digest trees of recorded runs: a hash for each batch, stage and run that grows with what it covers and tells its order.

A record's hash covers its key, its payload and its place, so sums of hashes tell order and can be added up in any order, by
partition. Two runs are compared from the root down; only below a node that differs are its children looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lineage, records


def leaf(place: Column, *parts: Column) -> Column:
    """A number below 2^60 of a place and what stands there; null and empty parts differ."""
    named = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", place.cast("string"), *named)), 1, 15), 16, 10).cast("decimal(38,0)")


def leaves(calls: DataFrame, stage: str, order: list[str], parts: list[str], size: int = records.BATCH) -> DataFrame:
    """(stage, batch_no, place, digest, parts...) of the calls of a run, size to a batch, in order."""
    batched = records.batches(calls, stage, order, size)
    return lineage.cut(batched.select(F.col(stage).alias("stage"), "batch_no", "place", leaf(F.col("place"), *[F.col(p) for p in parts]).alias("digest"), *parts))


def nodes(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, digest) a level up: rows are leaves or nodes further down; their digests are hashed with the place that they
    have under their new parent, but for leaves, which have it in them."""
    if "place" in rows.columns:
        return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("digest").alias("digest"))
    below = [c for c in rows.columns if c in ("stage", "batch_no") and c not in by]
    each = leaf(F.concat_ws("/", *[F.col(c).cast("string") for c in below]), F.col("digest"), F.col("n"))
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(each).alias("digest"))


def _differ(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Nodes that one side lacks or that have another digest or number of records."""
    left = a.select(*by, F.col("n").alias("n_expected"), F.col("digest").alias("_a"))
    right = b.select(*by, F.col("n").alias("n_actual"), F.col("digest").alias("_b"))
    both = left.join(right, by, "full") if by else left.crossJoin(F.broadcast(right))  # a row each
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.where(~(F.col("_a").eqNullSafe(F.col("_b")) & F.col("n_expected").eqNullSafe(F.col("n_actual")))).select(*by, zero("n_expected"), zero("n_actual"))


def compare(expected: DataFrame, actual: DataFrame, parts: list[str]) -> dict[str, DataFrame]:
    """What differs between two runs' leaves(): run (a row or none), stages, batches (with n_places, how many places differ) and
    records (stage, batch_no, place, status: missing, unexpected or different). A level is read only within what differs above."""
    sides = []
    for rows in (expected, actual):
        batches = lineage.cut(nodes(rows, ["stage", "batch_no"]))
        stages = lineage.cut(nodes(batches, ["stage"]))
        sides.append((rows, batches, stages, nodes(stages, [])))
    (la, ba, sa, ra), (lb, bb, sb, rb) = sides
    run = lineage.cut(_differ(ra, rb, []))
    if run.isEmpty():
        empty = lambda by: _differ(ba, bb, ["stage", "batch_no"]).select(*by).limit(0)
        gone = empty(["stage", "batch_no"]).withColumns({"place": F.lit(0), "status": F.lit("")})
        return {"run": run, "stages": empty(["stage", "n_expected", "n_actual"]), "batches": empty(["stage", "batch_no", "n_expected", "n_actual"]).withColumn("n_places", F.lit(0).cast("long")), "records": gone}
    stages = lineage.cut(_differ(sa, sb, ["stage"]))
    within = lambda df, above, by: df.join(F.broadcast(above.select(*by)) if lineage.small(above) else above.select(*by), by, "left_semi")
    batches = lineage.cut(_differ(within(ba, stages, ["stage"]), within(bb, stages, ["stage"]), ["stage", "batch_no"]))
    key = ["stage", "batch_no"]
    left = within(la, batches, key).select(*key, "place", F.col("digest").alias("_a"))
    right = within(lb, batches, key).select(*key, "place", F.col("digest").alias("_b"))
    both = left.join(right, [*key, "place"], "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").otherwise("different")
    found = lineage.cut(both.select(*key, "place", status.alias("status")))
    counted = batches.join(found.groupBy(*key).agg(F.count("*").alias("n_places")), key, "left").withColumn("n_places", F.coalesce("n_places", F.lit(0)))
    return {"run": run, "stages": stages, "batches": counted, "records": found}
