"""Reports over runs: clustered rates, accuracy by stratum, families of contrasts, ranks of draws, selector effects, latency.

Every interval comes from hashed draws, so reports agree between engines and reruns. Groups are those of by, which hold
no nulls: rows with a null there belong to no run and are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lineage, stats

#: Names that are compared with each other, and arms of a unit, at most.
MOST_NAMES = 1000


def _named(df: DataFrame, by: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.lit(True)))


def _long(df: DataFrame, keep: list[str], metrics: dict[str, dict[str, Column]]) -> DataFrame:
    """A row for each metric, with its columns beside those of keep."""
    each = [F.struct(F.lit(name).alias("metric"), *[c.cast("double").alias(k) for k, c in columns.items()]) for name, columns in metrics.items()]
    return df.select(*keep, F.explode(F.array(*each)).alias("_m")).select(*keep, "_m.*")


def clustered_rates(calls: DataFrame, by: list[str], unit: str, metrics: dict[str, tuple[Column, Column]], replicates: int = stats.REPLICATES, alpha: float = stats.ALPHA) -> DataFrame:
    """(by..., metric, estimate, lo, hi, n_units, n): ratios of sums, units being drawn whole.

    metrics: name -> (numerator, denominator), aggregates over a unit's calls. A unit whose denominator is 0 or null isn't
    one of that metric's; a metric without units has no row. Calls are folded to units before anything is drawn.
    """
    folded = [f for i, (num, den) in enumerate(metrics.values()) for f in (num.alias(f"_n{i}"), den.alias(f"_d{i}"))]
    per = _named(calls, by).groupBy(*by, unit).agg(*folded)
    long = _long(per, [*by, unit], {m: {"num": F.col(f"_n{i}"), "den": F.col(f"_d{i}")} for i, m in enumerate(metrics)}).where("den > 0")
    keys = [*by, "metric"]
    draws = stats.hashed_draws(long, keys, unit, ["num", "den"], replicates).withColumn("v", F.col("num") / F.col("den"))
    whole = long.groupBy(*keys).agg((F.sum("num") / F.sum("den")).alias("estimate"), F.count("*").alias("n_units"), F.sum("den").cast("long").alias("n"))
    return whole.join(stats.draw_interval(draws, keys, "v", alpha).drop("n"), keys).select(*keys, "estimate", "lo", "hi", "n_units", "n")


def failure_report(calls: DataFrame, run: str, levels: list[str], unit: str, replicates: int = stats.REPLICATES) -> DataFrame:
    """(run, level, name, metric, estimate, lo, hi, n_units, n): how calls fail, for each value of each level (stage, role).

    calls: failed, strict_ok, protocol_ok (boolean; null is false), salvaged (boolean), source (parsed, salvaged or
    fallback; null if nothing consumed the call), copy_rate (double; null where nothing is copied). any_failure and copy_rate are of
    questions, the others of calls; salvaged is a share of the failed.
    """
    rows = calls.withColumn("_l", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("name")) for x in levels]))).select("*", "_l.*")
    is_true = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    every, failed = F.count("*"), F.coalesce(F.col("failed"), F.lit(False))
    metrics = {
        "failure": (is_true("failed"), every),
        "any_failure": (F.max(failed.cast("int")), F.lit(1)),
        "salvaged": (F.count_if(failed & F.coalesce(F.col("salvaged"), F.lit(False))), is_true("failed")),
        "used_salvage": (F.count_if(F.col("source") == "salvaged"), F.count("source")),
        "strict": (is_true("strict_ok"), every),
        "protocol": (is_true("protocol_ok"), every),
        "copy_rate": (F.avg("copy_rate"), F.max(F.col("copy_rate").isNotNull().cast("int"))),
    }
    return clustered_rates(rows, [run, "level", "name"], unit, metrics, replicates)


def accuracy(answers: DataFrame, run: str, stratum: str, unit: str, values: list[str], tiny: int, replicates: int = stats.REPLICATES, total: str = "all") -> DataFrame:
    """(run, stratum, metric, estimate, lo, hi, n_units, appendix): means by run, over all and over each stratum. A run of
    fewer than tiny units belongs in the appendix. Null values don't count."""
    both = answers.withColumn("_s", F.explode(F.array(F.lit(total), F.col(stratum)))).drop(stratum).withColumnRenamed("_s", stratum)
    out = clustered_rates(both, [run, stratum], unit, {v: (F.sum(v), F.count(v)) for v in values}, replicates)
    sizes = answers.groupBy(run).agg((F.countDistinct(unit) < tiny).alias("appendix"))
    return out.drop("n").join(sizes, run)


def contrasts(rows: DataFrame, arm: str, unit: str, metrics: list[str], baseline: str) -> DataFrame:
    """(arm, metric, unit, difference): every other arm less the baseline. All arms have a row for every unit, which is
    checked: another number of rows is an error. A unit's rows are as many as there are arms, MOST_NAMES at most."""
    per = rows.groupBy(unit).agg(F.collect_list(F.struct(arm, *metrics)).alias("_a"), F.count_distinct(arm).alias("_n"), F.max(F.when(F.col(arm) == baseline, F.struct(*metrics))).alias("_b"))
    arms = rows.agg(F.count_distinct(arm).alias("_arms"))  # one row
    arms = arms.select(F.when(F.col("_arms") <= MOST_NAMES, F.col("_arms")).otherwise(F.raise_error(F.lit("there are too many arms")).cast("long")).alias("_arms"))
    whole = (F.size("_a") == F.col("_arms")) & (F.col("_n") == F.col("_arms")) & F.col("_b").isNotNull()
    checked = per.crossJoin(F.broadcast(arms)).withColumn("_a", F.when(whole, F.col("_a")).otherwise(F.raise_error(F.lit("arms have different units")).cast(per.schema["_a"].dataType)))
    each = checked.select(unit, "_b", F.explode("_a").alias("_x")).where(F.col(f"_x.{arm}") != baseline).withColumn(arm, F.col(f"_x.{arm}"))
    return _long(each, [arm, unit], {m: {"difference": F.col(f"_x.{m}") - F.col(f"_b.{m}")} for m in metrics})


def effects(rows: DataFrame, arm: str, unit: str, metrics: list[str], baseline: str, replicates: int = stats.REPLICATES) -> tuple[DataFrame, DataFrame]:
    """Means (arm, metric, estimate, n_units) and draws (arm, metric, draw, v) of contrasts with the baseline. Arms have
    the same units; a unit's contrasts stand in one row, so all share the picks of a draw and their draws may be added up."""
    diffs = lineage.cut(contrasts(rows, arm, unit, metrics, baseline))
    arms = [r[0] for r in diffs.select(arm).distinct().orderBy(arm).limit(MOST_NAMES + 1).collect()]  # contrasts() allows no more
    named = {f"_x{i}": (a, m) for i, (a, m) in enumerate((a, m) for a in arms for m in metrics)}
    wide = diffs.groupBy(unit).agg(*[F.max(F.when((F.col(arm) == a) & (F.col("metric") == m), F.col("difference"))).alias(x) for x, (a, m) in named.items()])
    draws = stats.hashed_draws(wide, [], unit, list(named), replicates)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias(arm), F.lit(m).alias("metric"), (F.col(x) / F.col("n")).alias("v")) for x, (a, m) in named.items()]))
    means = diffs.groupBy(arm, "metric").agg(F.avg("difference").alias("estimate"), F.count("*").alias("n_units"))
    return means, draws.select("draw", each.alias("_e")).select("_e.*", "draw")


def family(rows: DataFrame, arm: str, unit: str, metrics: list[str], baseline: str, adjusted: str, replicates: int = stats.REPLICATES) -> DataFrame:
    """(arm, metric, estimate, lo, hi, p, adjusted, n_units): a family of contrasts; p is two-sided, of no difference, and
    Holm's values are given for one metric only, the family's primary one."""
    means, draws = effects(rows, arm, unit, metrics, baseline, replicates)
    keys = [arm, "metric"]
    far = F.count_if(F.abs(F.col("v") - F.col("estimate")) >= F.abs("estimate") - 1e-12)
    p = draws.join(F.broadcast(means), keys).groupBy(*keys, "estimate", "n_units").agg(((far + 1) / (replicates + 1.0)).alias("p"))  # means: a row for each contrast
    out = stats.holm(p, ["metric"], arm, "p").withColumn("adjusted", F.when(F.col("metric") == adjusted, F.col("adjusted")))
    return out.join(stats.draw_interval(draws, keys, "v").drop("n"), keys).select(*keys, "estimate", "lo", "hi", "p", "adjusted", "n_units")


def ranked_draws(draws: DataFrame, name: str, value: str) -> DataFrame:
    """draws (name, draw, value) with k, the mean rank within the draw, the greatest first, and the shares of the first and
    the last place, ties splitting them."""
    w = Window.partitionBy("draw")
    ties = F.count("*").over(Window.partitionBy("draw", value))
    share = lambda best: F.when(F.col(value) == best(value).over(w), 1.0 / ties).otherwise(0.0)
    return draws.select(name, "draw", value, stats.ranks_with_ties(draws, ["draw"], value).alias("k"), share(F.max).alias("most"), share(F.min).alias("least"))


def rank_report(draws: DataFrame, name: str, value: str, alpha: float = stats.ALPHA) -> DataFrame:
    """(name, mean_rank, rank_lo, rank_hi, p_most, p_least): interval bounds are the values nearest to the quantiles."""
    folded = ranked_draws(draws, name, value).groupBy(name).agg(F.sort_array(F.collect_list("k")).alias("_k"), F.avg("k").alias("mean_rank"), F.avg("most").alias("p_most"), F.avg("least").alias("p_least"))
    at = lambda q: F.get("_k", F.bround(F.lit(q) * (F.size("_k") - 1)).cast("int"))
    return folded.select(name, "mean_rank", at(alpha / 2).alias("rank_lo"), at(1 - alpha / 2).alias("rank_hi"), "p_most", "p_least")


def rank_distribution(draws: DataFrame, name: str, value: str) -> DataFrame:
    """(name, rank, p): how often a name has each rank."""
    counts = ranked_draws(draws, name, value).groupBy(name, F.col("k").alias("rank")).agg(F.count("*").alias("c"))
    return counts.select(name, "rank", (F.col("c") / F.sum("c").over(Window.partitionBy(name))).alias("p"))


def pairwise(draws: DataFrame, name: str, value: str) -> DataFrame:
    """(name, other, p_greater): how often one name's value is strictly greater than another's in the same draw. There is a
    row for each two names, so more than MOST_NAMES are an error; draws are joined by number."""
    if draws.select(name).distinct().count() > MOST_NAMES:
        raise ValueError(f"there are more than {MOST_NAMES} names to compare with each other")
    other = draws.select("draw", F.col(name).alias("other"), F.col(value).alias("_o"))
    both = draws.join(other, "draw").where(F.col(name) != F.col("other"))
    return both.groupBy(name, "other").agg(F.avg((F.col(value) > F.col("_o")).cast("int")).alias("p_greater"))


def selector_effects(rows: DataFrame, role: str, configuration: str, unit: str, value: str, baseline: str, replicates: int = stats.REPLICATES) -> DataFrame:
    """(role, configuration, effect, draws): what each configuration changes in each role against the baseline run, for
    analytics.allocation. All share the picks of a draw; the baseline itself has effect 0 in all draws.

    rows (role, configuration, unit, value); the baseline's rows have it as configuration, in each role."""
    named = rows.withColumn("_arm", F.when(F.col(configuration) == baseline, F.lit(baseline)).otherwise(F.to_json(F.struct(role, configuration))))
    base = named.where(F.col(configuration) == baseline).groupBy("_arm", unit).agg(F.max(value).alias(value))
    means, draws = effects(base.unionByName(named.where(F.col(configuration) != baseline).select("_arm", unit, value)), "_arm", unit, [value], baseline, replicates)
    listed = draws.groupBy("_arm").agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "v"))), lambda x: x["v"]).alias("draws"))
    names = named.select("_arm", role, configuration).where(F.col(configuration) != baseline).distinct()
    others = names.join(means, "_arm").join(listed, "_arm").select(role, configuration, F.col("estimate").alias("effect"), "draws")
    zero = named.select(role).distinct().select(role, F.lit(baseline).alias(configuration), F.lit(0.0).alias("effect"), F.array_repeat(F.lit(0.0), replicates).alias("draws"))
    return others.unionByName(zero)


def eligible(calls: DataFrame, by: list[str], unit: str, passed: str, threshold: float, replicates: int = stats.REPLICATES) -> DataFrame:
    """(by..., estimate, lower, n_units, n, eligible): roles whose clustered lower bound reaches the threshold."""
    rates = clustered_rates(calls, by, unit, {"passed": (F.count_if(F.coalesce(F.col(passed), F.lit(False))), F.count("*"))}, replicates)
    return rates.select(*by, "estimate", F.col("lo").alias("lower"), "n_units", "n", (F.col("lo") >= threshold).alias("eligible"))


def stage_latency(batches: DataFrame, run: str, stage: str, batch: str, baseline: str, replicates: int = stats.REPLICATES) -> DataFrame:
    """(run, stage, estimate, lo, hi, n_batches, prompt_per_s, output_per_s, ratio): seconds a call by recorded batches
    (wall, size, prompt_tokens, output_tokens), tokens a second, and the ratio to the baseline's estimate."""
    rates = clustered_rates(batches, [run, stage], batch, {"wall": (F.sum("wall"), F.sum("size"))}, replicates).drop("metric", "n")
    speed = batches.groupBy(run, stage).agg(*[F.when(F.sum("wall") > 0, F.sum(t) / F.sum("wall")).alias(a) for t, a in (("prompt_tokens", "prompt_per_s"), ("output_tokens", "output_per_s"))])
    base = rates.where(F.col(run) == baseline).select(stage, F.col("estimate").alias("_base"))
    out = rates.withColumnRenamed("n_units", "n_batches").join(speed, [run, stage]).join(base, stage, "left")
    return out.withColumn("ratio", F.when(F.col("_base") > 0, F.col("estimate") / F.col("_base"))).drop("_base")


def system_latency(batches: DataFrame, run: str, strata: list[str], batch: str, questions: DataFrame, baseline: str, replicates: int = stats.REPLICATES) -> DataFrame:
    """(run, kind, estimate, lo, hi, ratio, ratio_lo, ratio_hi, n_batches): seconds a question, of generation alone and of
    the whole service. Batches are drawn within strata (stage, repeat) and added up; ratios to the baseline are taken draw
    by draw. batches: generation and service seconds; questions: (run, n), one row for each run."""
    kinds = ("generation", "service")
    each = lambda df, keep: _long(df, keep, {k: {"s": F.col(k)} for k in kinds}).withColumnRenamed("metric", "kind")
    sizes = F.broadcast(questions.select(run, F.col("n").alias("_q")))
    draws = stats.hashed_draws(_named(batches, [run, *strata]), [run, *strata], batch, list(kinds), replicates)
    per = each(draws.groupBy(run, "draw").agg(*[F.sum(k).alias(k) for k in kinds]), [run, "draw"]).join(sizes, run).select(run, "kind", "draw", (F.col("s") / F.col("_q")).alias("v"))
    whole = _named(batches, [run, *strata]).groupBy(run).agg(*[F.sum(k).alias(k) for k in kinds], F.count("*").alias("n_batches"))
    whole = each(whole, [run, "n_batches"]).join(sizes, run).select(run, "kind", (F.col("s") / F.col("_q")).alias("estimate"), "n_batches")
    of_base = lambda df, keys, c: df.join(df.where(F.col(run) == baseline).select(*keys, F.col(c).alias("_base")), keys, "left").withColumn("ratio", F.when(F.col("_base") > 0, F.col(c) / F.col("_base"))).drop("_base")
    per, whole = of_base(per, ["kind", "draw"], "v"), of_base(whole, ["kind"], "estimate")
    keys = [run, "kind"]
    out = whole.join(stats.draw_interval(per, keys, "v").drop("n"), keys)
    return out.join(stats.draw_interval(per, keys, "ratio").select(*keys, F.col("lo").alias("ratio_lo"), F.col("hi").alias("ratio_hi")), keys, "left")


def batch_coverage(batches: DataFrame, members: DataFrame, calls: DataFrame, batch: str, call: list[str], fingerprint: str) -> dict[str, DataFrame]:
    """Checks for analytics.expectations, each a DataFrame of violations. batches (batch, size, fingerprint), members
    (batch, call...), calls (call...): batches recorded twice or without members, sizes that aren't the number of members,
    calls in no batch, in several, or members that are no call, and fingerprints beyond the first."""
    counted = members.groupBy(batch).agg(F.count("*").alias("_m"))
    sized = batches.join(counted, batch, "left")
    return {
        "batches_recorded_twice": batches.groupBy(batch).count().where("count > 1"),
        "batches_without_members": sized.where("_m is null"),
        "sizes_of_members": sized.where(F.col("_m") != F.col("size")),
        "calls_without_batch": calls.select(*call).distinct().join(members, call, "left_anti"),
        "members_without_call": members.join(calls, call, "left_anti"),
        "calls_in_several_batches": members.groupBy(*call).agg(F.count_distinct(batch).alias("_b")).where("_b > 1"),
        "further_fingerprints": batches.select(fingerprint).where(F.col(fingerprint).isNotNull()).distinct().exceptAll(batches.agg(F.min(fingerprint).alias(fingerprint)).where(F.col(fingerprint).isNotNull())),
    }


def orchestration_coverage(records: DataFrame, stage: str, repeat: str, call_graph: str, stages: DataFrame, repeats: int) -> dict[str, DataFrame]:
    """Checks for analytics.expectations: a stage has one record for each repeat, from 0, and the same call graph in all."""
    wanted = stages.select(stage).distinct().select(stage, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))).alias(repeat))
    counted = records.groupBy(stage, F.col(repeat).cast("long").alias(repeat)).agg(F.count("*").alias("_n"))
    return {
        "repeats_missing": wanted.join(counted, [stage, repeat], "left_anti"),
        "repeats_recorded_twice": counted.where("_n > 1"),
        "repeats_unexpected": counted.join(wanted, [stage, repeat], "left_anti"),
        "call_graphs_differ": records.groupBy(stage).agg(F.count_distinct(call_graph).alias("_g")).where("_g > 1"),
    }
