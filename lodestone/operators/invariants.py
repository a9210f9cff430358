"""Invariants of a table: all checks of rows and of groups in one pass, orders of ids, and the deltas of a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage
from .corpus import numbered


def checked(df: DataFrame, rows: dict[str, Column], by: list[str] | None = None, groups: dict[str, Column] | None = None) -> DataFrame:
    """(name, violations, ok): how many rows violate each of rows, and how many groups each of groups.

    rows: name -> condition of a violation, over columns; groups: name -> the same over aggregates of a group of by. A null
    condition is no violation. The table is read once: rows are counted within groups, and groups are added up. An empty table
    violates nothing."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"_r{i}") for i, c in enumerate(rows.values())]
    flags = [F.coalesce(c, F.lit(False)).cast("long").alias(f"_g{i}") for i, c in enumerate((groups or {}).values())]
    names = [*rows, *(groups or {})]
    if len(set(names)) < len(names):
        raise ValueError("a check is named twice")
    if not names:
        raise ValueError("there is nothing to check")
    per = df.groupBy(*by).agg(*counts, *flags) if groups else df.agg(*counts)
    columns = [*(f"_r{i}" for i in range(len(rows))), *(f"_g{i}" for i in range(len(groups or {})))]
    total = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns])
    each = total.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("violations")) for n, c in zip(names, columns, strict=True)])).alias("x")).select("x.*")
    return each.withColumn("ok", F.col("violations") == 0)


def order_differences(a: DataFrame, b: DataFrame, key: str, order_a: list[str], order_b: list[str]) -> DataFrame:
    """(place, left, right): where the keys of a in order and those of b in order aren't the same, null where one is shorter.
    Places are taken by ranges and joined, so no side is gathered."""
    left = numbered(a.select(F.col(key).alias("left"), *order_a), order_a, "place").select("place", "left")
    right = numbered(b.select(F.col(key).alias("right"), *order_b), order_b, "place").select(F.col("place").alias("_place"), "right", F.lit(True).alias("_b"))
    both = left.withColumn("_a", F.lit(True)).join(right, F.col("place") == F.col("_place"), "full")
    differs = F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("left").eqNullSafe(F.col("right"))
    return both.where(differs).select(F.coalesce("place", "_place").alias("place"), "left", "right")


def deltas(runs: DataFrame, run: str, baseline: str, limits: dict[str, float]) -> DataFrame:
    """(run, metric, value, base, delta, passed): every run but the baseline against it. limits: metric -> the least delta
    allowed; a metric that is null on either side isn't passed. runs: a row a run."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(x)).alias("limit")) for m, x in limits.items()]))
    long = runs.select(run, each.alias("x")).select(run, "x.*")
    base = F.max(F.when(F.col(run) == baseline, F.col("value"))).over(Window.partitionBy("metric"))  # a row for each run
    out = long.withColumn("base", base).where(F.col(run) != baseline).withColumn("delta", F.col("value") - F.col("base"))
    return out.select(run, "metric", "value", "base", "delta", F.coalesce(F.col("delta") >= F.col("limit"), F.lit(False)).alias("passed"))


# --- calls by what they are for --------------------------------------------------------------------------------------


def conceptual(calls: DataFrame, stages: DataFrame, keys: list[str], without: tuple[str, ...] = ("plan_summary",)) -> DataFrame:
    """calls with concept and step, by the table of stages (stage, concept, step, role), without the concepts of without.

    A stage that the table doesn't have, a call whose prompt was of another role than its stage's, and a key (keys, concept, step)
    met twice are errors. stages is small; it is a row a stage."""
    table = stages.select(F.col("stage"), "concept", "step", F.col("role").alias("_role"), F.lit(True).alias("_known"))
    rows = calls.join(F.broadcast(table) if lineage.small(table) else table, "stage", "left")
    wrong = F.when(F.col("_known").isNull(), F.concat(F.lit("no such stage: "), F.coalesce("stage", F.lit("null")))).when(~F.col("role").eqNullSafe(F.col("_role")), F.concat(F.lit("a prompt of another role in "), "stage"))
    rows = rows.withColumn("concept", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("concept")))
    kept = rows.where(~F.col("concept").isin(*without)).drop("_role", "_known")
    held = [c for c in kept.columns if c not in (*keys, "concept", "step")]
    once = kept.groupBy(*keys, "concept", "step").agg(F.count("*").alias("_n"), F.max_by(F.struct(*held), F.lit(1)).alias("_x"))
    return once.select(*keys, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("a call is met twice: "), "concept")).cast("string")).otherwise(F.col("concept")).alias("concept"), "step", "_x.*")


def churn(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(concept, n_left, n_right, n_both, strict, strict_changed, effective_changed, route_changed) for calls as conceptual() gives them, with
    strict and effective payloads (null: none) and route.

    strict_changed counts among the calls that were parsed strictly in both runs (strict of them), the others among all in both:
    effective payloads are what the run went on with, by whichever route."""
    names = [*keys, "concept", "step"]
    right = b.select(*names, *[F.col(c).alias(f"_{c}") for c in ("strict", "effective", "route")], F.lit(True).alias("_b"))
    both = a.select(*names, "strict", "effective", "route", F.lit(True).alias("_a")).join(right, names, "full")
    met = F.col("_a") & F.col("_b")
    strictly = met & F.col("strict").isNotNull() & F.col("_strict").isNotNull()
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return both.groupBy("concept").agg(
        count(F.col("_a")).alias("n_left"), count(F.col("_b")).alias("n_right"), count(met).alias("n_both"), count(strictly).alias("strict"), count(strictly & differs("strict")).alias("strict_changed"),
        count(met & differs("effective")).alias("effective_changed"), count(met & differs("route")).alias("route_changed"),
    )
