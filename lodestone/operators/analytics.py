"""Comparisons over runs: contrasts, strata, churn, Pareto fronts, allocation, plans, expectations."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage
from .corpus import numbered


def paired(a: DataFrame, b: DataFrame, unit: str, value: str, scale: float = 100.0) -> DataFrame:
    """(unit, difference): a - b by unit, times scale. Units of one side only are an error; an inner join would drop them
    silently."""
    both = a.select(unit, F.col(value).alias("_a"), F.lit(True).alias("_ina")).join(b.select(unit, F.col(value).alias("_b"), F.lit(True).alias("_inb")), unit, "full")
    alone = F.col("_ina").isNull() | F.col("_inb").isNull()
    checked = F.when(alone, F.raise_error(F.lit("the runs have different units")).cast("double")).otherwise((F.col("_a") - F.col("_b")) * scale)
    return both.select(unit, checked.alias("difference"))


def churn(a: DataFrame, b: DataFrame, keys: list[str], differs: Column, by: list[str]) -> DataFrame:
    """(by..., n_shared, n_changed, n_left, n_right): over keys of both sides, how many differ, and how many one side only
    has. Columns of b are named b_...; by are keys."""
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys], F.lit(True).alias("_inb"))
    both = a.withColumn("_ina", F.lit(True)).join(right, keys, "full")
    shared = F.col("_ina").isNotNull() & F.col("_inb").isNotNull()
    return both.groupBy(*by).agg(F.count_if(shared).alias("n_shared"), F.count_if(shared & differs).alias("n_changed"), F.count_if(F.col("_inb").isNull()).alias("n_left"), F.count_if(F.col("_ina").isNull()).alias("n_right"))


def pareto(points: DataFrame, name: str, cost: str, gain: str) -> DataFrame:
    """Points that no other beats: none costs as little or less and gains as much or more, one of them strictly.

    Equal costs are folded to their greatest gain, ranges of costs to theirs, and a point stays if it gains more than all
    cheaper ones. No pair of points is ever formed."""
    levels = points.groupBy(F.col(cost).alias("_c")).agg(F.max(gain).alias("_g"))
    ranged = lineage.cut(levels.repartitionByRange("_c").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.max("_g").alias("_top"))
    before = parts.withColumn("_before", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", "_before")
    within = F.max("_g").over(Window.partitionBy("_part").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    best = ranged.withColumn("_within", within).join(F.broadcast(before), "_part")
    best = best.where((F.col("_within").isNull() | (F.col("_g") > F.col("_within"))) & (F.col("_before").isNull() | (F.col("_g") > F.col("_before"))))
    front = best.select("_c", "_g")
    return points.join(front, (F.col(cost) == F.col("_c")) & (F.col(gain) == F.col("_g"))).select(name, cost, gain)


def best_within(budgets: DataFrame, budget: str, points: DataFrame, name: str, cost: str, gain: str) -> DataFrame:
    """budgets with best_name and best_gain: of the points that cost no more, the one of the greatest gain, ties to the
    cheaper, then by name. Points and budgets are ordered together and the best so far is carried along."""
    p = points.select(F.lit(None).cast(dict(budgets.dtypes)[budget]).alias("_b"), F.col(cost).cast("double").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(gain).alias("g"), (-F.col(cost)).alias("c"), F.col(name).alias("n")).alias("_p"))
    # one row for each cost: the best of it
    p = p.groupBy("_at").agg(F.max_by("_p", F.struct("_p.g", "_p.c")).alias("_p")).select(F.lit(None).cast(dict(budgets.dtypes)[budget]).alias("_b"), "_at", F.lit(0).alias("_kind"), "_p")
    b = budgets.select(F.col(budget).alias("_b")).distinct().select("_b", F.col("_b").cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"))
    every = lineage.cut(p.unionByName(b).repartitionByRange("_at").withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    parts = every.groupBy("_part").agg(F.max("_p").alias("_top")).withColumn("_before", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    best = every.withColumn("_so_far", F.max("_p").over(w)).join(F.broadcast(parts.select("_part", "_before")), "_part").where("_kind = 1")
    top = F.when(F.col("_so_far").isNull() | (F.col("_before") > F.col("_so_far")), F.col("_before")).otherwise(F.col("_so_far"))
    best = best.withColumn("_best", top).select(F.col("_b").alias(budget), F.col("_best.n").alias("best_name"), F.col("_best.g").alias("best_gain"))
    return budgets.join(best, budget, "left")


def _summed(rows: DataFrame, by: list[str], best: bool = False) -> DataFrame:
    """(by..., draws): draws added up place by place, or the greatest of each place."""
    each = rows.select(*by, F.posexplode("draws").alias("_at", "_v")).groupBy(*by, "_at").agg((F.max if best else F.sum)("_v").alias("_v"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias("draws"))


def allocation(effects: DataFrame, memory: DataFrame, roles: list[str], margin: float, alpha: float = 0.05) -> DataFrame:
    """One row: the cheapest assignment of a configuration to each role whose lower bound isn't below -margin.

    effects (role, configuration, effect, draws: array of as many doubles for all), memory (configuration, footprint).
    Effects and draws add up; a configuration counts once for memory; ties go to the greater effect, then fewer
    configurations, then by name. Assignments grow a role at a time, with their draws summed along, and one is given up as soon
    as it costs more than the cheapest allowed one of a single configuration, or would fall below the margin even if each role
    to come had its best value in every draw; of two with the same configurations and draws only the better goes on. What is
    left is complete, so the result is that of comparing all.
    """
    effects = lineage.cut(effects.select("role", "configuration", "effect", "draws"))
    place = lambda d: F.get(F.sort_array(d), F.floor(F.lit(alpha / 2) * F.size(d)).cast("int"))
    sizes = F.map_from_entries(F.collect_list(F.struct("configuration", "footprint")))
    sizes = F.broadcast(memory.select("configuration", F.col("footprint").cast("double").alias("footprint")).agg(sizes.alias("sizes")))  # one row
    known = effects.where(F.col("role").isin(roles))
    whole = known.groupBy("configuration").agg(F.count_distinct("role").alias("_r")).where(F.col("_r") == len(set(roles))).select("configuration")
    alone = _summed(known.join(whole, "configuration"), ["configuration"]).where(F.round(place("draws"), 9) >= -margin) if len(set(roles)) == len(roles) else None
    limit = alone.join(memory, "configuration").agg(F.min("footprint")).first()[0] if alone is not None else None

    done = effects.select(F.size("draws").alias("_n")).limit(1).select(F.array().cast("array<string>").alias("names"), F.lit(0.0).alias("effect"), F.array_repeat(F.lit(0.0), F.col("_n")).alias("draws"))
    cost = lambda used: F.aggregate(used, F.lit(0.0), lambda s, c: s + F.element_at("sizes", c))
    for i, role in enumerate(roles):
        one = effects.where(F.col("role") == role).select("configuration", F.col("effect").alias("_e"), F.col("draws").alias("_d"))
        done = done.crossJoin(F.broadcast(one)).select(F.array_append("names", F.col("configuration")).alias("names"), (F.col("effect") + F.col("_e")).alias("effect"), F.zip_with("draws", "_d", lambda a, b: a + b).alias("draws"))  # a role's few configurations
        if limit is not None:
            done = done.crossJoin(sizes).where(cost(F.array_distinct("names")) <= limit + 1e-9).drop("sizes")
        reach = F.col("draws")
        if later := [effects.where(F.col("role") == r) for r in roles[i + 1 :]]:
            best = reduce(DataFrame.unionByName, [_summed(r, [], best=True) for r in later])
            done, reach = done.crossJoin(F.broadcast(_summed(best, []).withColumnRenamed("draws", "_rest"))), F.zip_with("draws", "_rest", lambda a, b: a + b)  # one row
        done = done.where(place(reach) >= -margin - 1e-8).select("names", "effect", "draws")
        better = F.struct(F.round(-F.col("effect"), 9).alias("e"), F.array_join("names", ",").alias("a"), "names", "effect")
        same = done.groupBy(F.sort_array(F.array_distinct("names")).alias("_used"), "draws").agg(F.min(better).alias("_x"))
        done = lineage.cut(same.select("_x.names", "_x.effect", "draws"))
    every = done.select("names", "effect", place("draws").alias("lower")).crossJoin(sizes)
    used = F.array_distinct("names")
    every = every.select(F.array_join("names", ",").alias("allocation"), F.round("effect", 9).alias("effect"), F.round("lower", 9).alias("lower"), F.size(used).alias("n_configs"), cost(used).alias("footprint"))
    return every.where(F.col("lower") >= -margin).orderBy("footprint", F.desc("effect"), "n_configs", "allocation").limit(1)


def zero_filled(units: DataFrame, kinds: DataFrame, facts: DataFrame, unit: str, kind: str, values: list[str]) -> DataFrame:
    """(unit, kind, n, values...): count and sums of facts for every unit and kind, 0 where there are none. kinds are few."""
    sums = facts.groupBy(unit, kind).agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values])
    every = units.select(unit).distinct().crossJoin(F.broadcast(kinds.select(kind).distinct()))
    return every.join(sums, [unit, kind], "left").select(unit, kind, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", *values)])


def strata(df: DataFrame, by: str, stratum: str, values: list[str], total: str = "all") -> DataFrame:
    """(by, stratum, n, mean_...): means over everything of by and over each stratum; nulls don't count."""
    sets = df.groupingSets([[by], [by, stratum]], by, stratum)
    out = sets.agg(F.grouping(stratum).alias("_all"), F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])
    return out.withColumn(stratum, F.when(F.col("_all") == 1, total).otherwise(F.col(stratum))).drop("_all")


def expectations(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, violations, ok): each check is a DataFrame of violating rows."""
    counted = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations") for name, df in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), counted).withColumn("ok", F.col("violations") == 0)


def set_difference(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(columns..., side): rows of only one side."""
    missing = expected.exceptAll(present).withColumn("side", F.lit("missing"))
    return missing.unionByName(present.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def shard_plan(df: DataFrame, order: str, workers: int) -> DataFrame:
    """df with worker and turn: rows in order, dealt round robin."""
    return numbered(df, [order], "_nth").withColumn("worker", (F.col("_nth") % workers).cast("int")).withColumn("turn", F.floor(F.col("_nth") / workers).cast("long")).drop("_nth")


def shuffled(ids: list[str], seed: int) -> list[str]:
    """Ids in the order of a seeded generator; for lists that a driver holds, like the runs of a campaign."""
    out = sorted(ids)
    random.Random(seed).shuffle(out)
    return out


def sampled(ids: list[str], n: int, seed: int) -> list[str]:
    """n of the ids by a seeded generator, in order."""
    return sorted(random.Random(seed).sample(sorted(ids), n))


def hash_sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by a hash of seed and key: the sample of tables that no driver holds."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def coalesced(df: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """df with a column for each name: the first of its synonyms that df has and that isn't null."""
    for name, columns in synonyms.items():
        there = [F.col(c) for c in columns if c in df.columns]
        df = df.withColumn(name, F.coalesce(*there) if there else F.lit(None))
    return df


def gate(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """metrics with decision: GO if every named column reaches its threshold, else STOP; null doesn't reach any."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) >= t, F.lit(False)) for c, t in thresholds.items()])
    return metrics.withColumn("decision", F.when(ok, "GO").otherwise("STOP"))
