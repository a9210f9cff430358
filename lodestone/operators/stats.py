"""Rank statistics, calibration, intervals and bootstraps.

Bootstraps come in two modes. The portable one picks the unit of a draw by a hash of (place, draw), so any engine gets
the same draws and tasks share the work of a stratum; the exact one runs numpy's generator over one group's values.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import corpus, lineage

#: Draws and level of the reference setting.
REPLICATES, ALPHA = 10_000, 0.05


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (auroc, n_pos, n_neg): the chance that a row labelled 1 scores above one labelled 0, ties half; null with one
    class. Null scores are left out. Rows are first counted by score, so equal scores are one row of the ranking, and the
    ranking is cut into ranges of scores that are summed up on their own."""
    levels = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    ranged = levels.repartitionByRange("s").withColumn("part", F.spark_partition_id())
    within = ranged.withColumn("below", F.coalesce(F.sum(F.col("n") - F.col("pos")).over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = within.groupBy("part").agg(F.sum(F.col("n") - F.col("pos")).alias("neg"), F.sum("pos").alias("pos"), F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2)).alias("wins"))
    parts = parts.withColumn("before", F.coalesce(F.sum("neg").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = parts.agg(F.sum(F.col("wins") + F.col("pos") * F.col("before")).alias("wins"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))
    return total.select(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"), "n_pos", "n_neg")


def bin_of(c: Column, bins: int) -> Column:
    """Which of the bins (i/n, (i+1)/n] holds c, 0 in the first; the bounds are compared, so no rounding moves a value."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(bins - 1)) if bins > 1 else F.array().cast("array<int>"), F.lit(0), lambda n, i: n + (c > i / F.lit(float(bins))).cast("int"))


def calibration_error(df: DataFrame, confidence: str, label: str, bins: int = 10) -> DataFrame:
    """One row (ece, n): the mean gap between confidence and accuracy of equal bins, weighted by size; null without rows.
    Null confidences are left out; one outside [0, 1] is an error."""
    if bins < 1:
        raise ValueError("bins must be positive")
    c = F.col(confidence)
    rows = df.where(c.isNotNull()).select(F.when((c >= 0) & (c <= 1), c).otherwise(F.raise_error(F.lit("a confidence is outside [0, 1]")).cast("double")).alias("c"), F.col(label).cast("double").alias("y"))
    per = rows.groupBy(bin_of(F.col("c"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("y").alias("y"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("c"))) / F.sum("n")).alias("ece"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def numbered_within(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with i, the place from 0 in the order of its group, and n, the group's size. Places in the order of all rows are
    taken by ranges, less where the group begins, so no group is one task's."""
    every = lineage.cut(corpus.numbered(df, [*by, *order], "_at"))
    groups = every.groupBy(*by).agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    if not by:
        return every.crossJoin(F.broadcast(groups)).withColumn("i", F.col("_at") - F.col("_first")).drop("_at", "_first")
    same = [every[b].eqNullSafe(F.col(f"_g_{b}")) for b in by]
    joined = every.join(groups.withColumnsRenamed({b: f"_g_{b}" for b in by}), same)
    return joined.withColumn("i", F.col("_at") - F.col("_first")).drop("_at", "_first", *[f"_g_{b}" for b in by])


def order_interval(df: DataFrame, by: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """(by..., lo, hi, n): the values at places int(alpha/2 * n) and min(int((1 - alpha/2) * n), n - 1) from 0 of each
    group's order; no interpolation. Draws of one statistic are one group."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    ranked = numbered_within(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v")), by, ["v"])
    lo = F.floor(F.lit(alpha / 2) * F.col("n"))
    hi = F.least(F.floor(F.lit(1 - alpha / 2) * F.col("n")), F.col("n") - 1)
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("i") == lo, F.col("v"))).alias("lo"), F.max(F.when(F.col("i") == hi, F.col("v"))).alias("hi"), F.max("n").alias("n"))


def holm(df: DataFrame, by: list[str], name: str, p: str) -> DataFrame:
    """df with adjusted: Holm's step-down values within each family of by; ties go by name."""
    order = Window.partitionBy(*by).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(*by))
    step = (m - F.row_number().over(order) + 1) * F.col(p)
    return df.withColumn("_step", step).withColumn("adjusted", F.least(F.lit(1.0), F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


#: Places that are filled at a time, distinct value vectors that they are looked up in, and vectors of a row that is sent to tasks.
PLACES, VECTORS, PACKED = 1 << 16, 10 << 20, 1 << 16
#: Places of a task are as many as the vectors that it is sent, divided by this, so that what is sent grows with units.
_COPIES = 8
#: Tasks that make draws, at most.
MOST_TASKS = 2000
#: Picks that are made at a time, and of numpy's generator.
_AT_ONCE, _TOGETHER = 1 << 16, 1 << 18
#: Different values of a stratum up to which picks are compared with each bound, and up to which they are sorted first.
_COMPARED, _SORTED = 16, 1 << 13
#: Places from which that pays, and values that are laid out unit by unit, of few and of many vectors.
_LONG, _LAID_OUT, _MANY = 4096, (20 << 20, 20 << 20), 1 << 16


@functools.lru_cache(256)
def words(seed: int, kind: str, lo: int, hi: int) -> np.ndarray:
    """A 32-bit word for each place (kind p) or draw (kind d): eight hex digits of an MD5."""
    return np.array([int(hashlib.md5(f"{seed}|{kind}|{i}".encode()).hexdigest()[:8], 16) for i in range(lo, hi)], np.uint32)


def _mixed(x: np.ndarray, spare: np.ndarray) -> None:
    """Mixes x, words of which the upper half has been added to the lower one, by multiplications modulo 2^32, in place."""
    x *= np.uint32(0x85EBCA6B)
    np.right_shift(x, np.uint32(13), out=spare)
    x ^= spare
    x *= np.uint32(0xC2B2AE35)
    np.right_shift(x, np.uint32(16), out=spare)
    x ^= spare


def _least_words(edges: np.ndarray, n: int) -> np.ndarray:
    """The smallest word that picks unit edge or a later one of n; edges are below n, and a word picks (word * n) >> 32."""
    up = edges.astype(np.uint64) << np.uint64(32)
    least = up // np.uint64(n)
    return (least + (least * np.uint64(n) != up)).astype(np.uint32)


def drawn_sums(values: np.ndarray, counts: np.ndarray, n: int, base: int, places: tuple[int, int], replicates: int, seed: int = 0, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each draw the sums over places of what fills them, and how many of these are among values: distinct vectors, one
    a row, of which counts units each have, and which begin at unit base of n. salt is the word of the stratum.

    Words of a place and a draw are joined and mixed; the result, scaled to n, is the unit. Vectors stand in order of units,
    so each has a range of words. Few vectors: picks are counted by comparing, or sorting, words with the bounds of these
    ranges, without looking up any. Else a table gives the vector of a word's first bits, and the few words whose first bits
    are of several vectors are looked up among the bounds."""
    lo, hi = places
    u = words(seed, "p", lo, lo + max(1024, 1 << (hi - lo - 1).bit_length()))[: hi - lo]
    v = words(seed, "d", 0, replicates) ^ np.uint32(salt)
    u, v = u ^ (u >> np.uint32(16)), v ^ (v >> np.uint32(16))
    width, total = values.shape[1], int(counts.sum())
    all_in = base == 0 and total == n
    by_bounds = len(u) >= _LONG and len(counts) <= _SORTED and np.isfinite(values).all()
    laid_out = not by_bounds and total * width <= _LAID_OUT[len(counts) >= _MANY]
    if not laid_out:
        edges = base + np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        least = _least_words(edges[edges < n], n)  # an edge at n has no word
    sums, n_in = np.zeros((replicates, width)), np.full(replicates, len(u), np.int64)
    x, spare = np.empty(max(1, _AT_ONCE // len(u)) * len(u), np.uint32), np.empty(max(1, _AT_ONCE // len(u)) * len(u), np.uint32)

    if by_bounds:
        x, spare, from_edge = x[: len(u)], spare[: len(u)], np.zeros(len(edges), np.int64)
        few, flag = len(counts) <= _COMPARED, np.empty(len(u), bool)
        for d in range(replicates):
            np.bitwise_xor(u, v[d], out=x)
            _mixed(x, spare)
            if few:
                from_edge[: len(least)] = [np.count_nonzero(np.greater_equal(x, t, out=flag)) for t in least]
            else:
                x.sort()
                from_edge[: len(least)] = len(x) - np.searchsorted(x, least)
            sums[d] = ((from_edge[:-1] - from_edge[1:])[:, None] * values).sum(axis=0)
            n_in[d] = from_edge[0] - from_edge[-1]
        return sums, n_in

    # two values are one complex number, so that a pick reads one place
    columns = [np.ascontiguousarray(values[:, k : k + 2]).view(np.complex128 if k + 1 < width else np.float64)[:, 0] for k in range(0, width, 2)]
    if laid_out:
        columns = [np.repeat(c, counts) for c in columns] if total > len(counts) else columns
    else:
        bits = min(22, max(16, len(counts).bit_length() + 5))
        first = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32 - bits)
        of = np.searchsorted(least, first[:-1].astype(np.uint32), "right")
        last = np.searchsorted(least, (first[1:] - np.uint64(1)).astype(np.uint32), "right")
        table = np.where(of == last, of - 1, -2)  # -1 is before the first vector, the number of vectors behind the last
    at, got = np.empty(len(x), np.int64), np.empty(len(x), np.complex128)
    step = max(1, _AT_ONCE // len(u))
    for d in range(0, replicates, step):
        rows = min(step, replicates - d)
        word, place = x[: rows * len(u)], at[: rows * len(u)]
        np.bitwise_xor(v[d : d + rows, None], u[None, :], out=word.reshape(rows, -1))
        _mixed(word, spare[: len(word)])
        if laid_out:
            scaled = place.view(np.uint64)
            np.copyto(scaled, word)
            scaled *= np.uint64(n)
            scaled >>= np.uint64(32)
            if base:
                place -= base
            size = total
        else:
            np.right_shift(word, np.uint32(32 - bits), out=spare[: len(word)])
            np.take(table, spare[: len(word)], out=place, mode="clip")
            unsure = np.flatnonzero(place == -2)
            place[unsure] = np.searchsorted(least, word[unsure], "right") - 1
            size = len(counts)
        inside = None if all_in else (place >= 0) & (place < size)
        if inside is not None:
            n_in[d : d + rows] = inside.reshape(rows, -1).sum(axis=1)
        for k, column in enumerate(columns):
            value = got.view(column.dtype)[: len(place)]
            np.take(column, place, out=value, mode="clip")
            if inside is not None:
                value[~inside] = 0
            sums[d : d + rows, 2 * k : 2 * k + 2] = value.reshape(rows, -1).sum(axis=1)[:, None].view(np.float64)
    return sums, n_in


def hashed_draws(units: DataFrame, strata: list[str], unit: str, sums: list[str], replicates: int, seed: int = 0) -> DataFrame:
    """(strata..., draw, sums..., n): for each draw and stratum, the sums over as many units, picked with replacement, as the
    stratum has. All sums of a draw go by the same picks; different strata are drawn independently, so what must share its
    picks belongs in one row. units: a row per unit; null values add nothing.

    Units stand in the order of their values, so those of equal values are one counted row, and no unit is numbered. A task
    makes all draws of some places, PLACES at a time, against up to VECTORS counted rows, and gives a sum for each draw; no row is
    made for a pick. Counted rows go to tasks packed, and to the fewer tasks the more they are. The work is units times
    draws, times each further VECTORS of different values in a stratum.
    The result, a row for each draw and stratum, is kept. strata [] is one stratum.
    """
    keys, values = [f"_k{i}" for i in range(len(strata))], [f"_v{i}" for i in range(len(sums))]
    rows = units.select(*[F.col(s).alias(k) for s, k in zip(strata, keys, strict=True)], *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(v) for s, v in zip(sums, values, strict=True)])
    counted = lineage.cut(rows.groupBy(*keys, *values).agg(F.count("*").alias("_c")))
    sizes = counted.groupBy(*[F.col(k).alias(f"_z{k}") for k in keys]).agg(F.sum("_c").alias("_n"), F.count("*").alias("_d"))
    most, widest = sizes.agg(F.max("_n"), F.max("_d")).first()
    if (widest or 0) <= VECTORS:
        blocks = counted.withColumns({"_b": F.lit(0).cast("long"), "_base": F.lit(0).cast("long")})
    else:
        placed = numbered_within(counted, keys, values).withColumn("_b", F.floor(F.col("i") / VECTORS)).drop("i", "n")
        held = placed.groupBy(*[F.col(k).alias(f"_h{k}") for k in keys], F.col("_b").alias("_hb")).agg(F.sum("_c").alias("_h"))
        before = Window.partitionBy(*[f"_h{k}" for k in keys]).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("_base", F.coalesce(F.sum("_h").over(before), F.lit(0))).drop("_h")
        on = [F.col("_b") == F.col("_hb"), *[F.col(k).eqNullSafe(F.col(f"_h{k}")) for k in keys]]
        blocks = placed.join(held, on).drop("_hb", *[f"_h{k}" for k in keys])
    if (most or 0) > 1 << 32:
        raise ValueError("a stratum may have 2^32 units at most")
    same = [F.col(k).eqNullSafe(F.col(f"_z{k}")) for k in keys]
    some = F.least("_d", F.lit(VECTORS))
    size = F.ceil(some / (_COPIES * PLACES)) * PLACES
    totals = sizes.withColumn("_g", F.ceil(some / PACKED)).withColumn("_size", size).drop("_d")
    whole = (blocks.join(totals, same) if keys else blocks.crossJoin(F.broadcast(totals))).drop(*[f"_z{k}" for k in keys])  # without keys, totals is one row
    salt = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long") if keys else F.lit(0).cast("long")
    kinds, held = dict(counted.dtypes), [*keys, "_b", "_base", "_n", "_size"]
    named = lambda *more: ", ".join([*(f"{k} {kinds[k]}" for k in keys), *more])

    def pack(group: pa.Table) -> pa.Table:
        x, c = np.column_stack([group.column(v).to_numpy() for v in values]), group.column("_c").to_numpy()
        return group.select(held).slice(0, 1).append_column("_x", pa.array([x.tobytes()], pa.binary())).append_column("_c", pa.array([c.tobytes()], pa.binary()))

    whole = whole.withColumn("_g", F.pmod(F.xxhash64(*values), "_g"))
    packed = whole.groupBy(*keys, "_b", "_g").applyInArrow(pack, named("_b long", "_base long", "_n long", "_size long", "_x binary", "_c binary")).withColumn("_s", salt)
    dealt = packed.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.col("_size")))))

    def run(group: pa.Table) -> pa.Table:
        x, c = (np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in group.column(name)]) for name, kind in (("_x", np.float64), ("_c", np.int64)))
        x = x.reshape(len(c), -1)
        order = np.lexsort(x.T[::-1])
        x, c = x[order], c[order]
        n, base, p, step, salt = (group.column(k)[0].as_py() for k in ("_n", "_base", "_p", "_size", "_s"))
        made, n_in = np.zeros((replicates, x.shape[1])), np.zeros(replicates, np.int64)
        for lo in range(p * step, min(n, (p + 1) * step), PLACES):
            sums_, in_ = drawn_sums(x, c, n, base, (lo, min(n, lo + PLACES)), replicates, seed, salt)
            made, n_in = made + sums_, n_in + in_
        one = pa.array(np.zeros(replicates, np.int64))
        columns = {k: group.column(k).take(one) for k in keys} | {"draw": pa.array(np.arange(replicates, dtype=np.int32))}
        return pa.table(columns | {v: pa.array(made[:, i]) for i, v in enumerate(values)} | {"n": pa.array(n_in)})

    # by number, since the rows are few and Spark would put them all in one task, but each group takes seconds or minutes: so many that few tasks get two
    tasks = sizes.agg(F.sum(F.ceil(F.col("_n") / size) * F.ceil(F.col("_d") / VECTORS))).first()[0] or 1
    dealt = dealt.repartition(min(MOST_TASKS, 8 * int(tasks)), *keys, "_b", "_p")
    parts = dealt.groupBy(*keys, "_b", "_p").applyInArrow(run, named("draw int", *(f"{v} double" for v in values), "n long"))
    if (most or 0) > PLACES or (widest or 0) > VECTORS:
        parts = parts.groupBy(*keys, "draw").agg(*[F.sum(v).alias(v) for v in values], F.sum("n").alias("n"))
    return lineage.cut(parts.withColumnsRenamed(dict(zip([*keys, *values], [*strata, *sums], strict=True))))


def draw_interval(draws: DataFrame, by: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """order_interval() of hashed draws: a group's rows are its draws, whose number is a parameter, so they fit an array."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    listed = draws.where(F.col(value).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_s")).withColumn("n", F.size("_s").cast("long"))
    at = lambda i: F.get("_s", i.cast("int"))
    return listed.select(*by, at(F.floor(F.lit(alpha / 2) * F.col("n"))).alias("lo"), at(F.least(F.floor(F.lit(1 - alpha / 2) * F.col("n")), F.col("n") - 1)).alias("hi"), "n")


def exact_means(df: DataFrame, by: list[str], unit: str, values: list[str], replicates: int = REPLICATES, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """(by..., metric, estimate, lo, hi, p, n): percentile intervals of means by numpy's generator, all values of a group
    sharing the draws; p is two-sided, of a mean of 0. Units are put in order first, so the order of rows doesn't count.
    One unit has its value as interval. A group's units are one task's, as the generator's draws follow each other; pieces of draws
    hold some 2 MB, or one draw of more units."""
    if replicates < 2:
        raise ValueError("replicates must be at least 2")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([unit, *values])
        x = pdf[values].to_numpy(np.float64)
        if not np.isfinite(x).all():
            raise ValueError("values must be finite")
        rng, means = np.random.default_rng(seed), []
        step = max(1, min(256, _TOGETHER // len(x)))
        for at in range(0, replicates, step):
            means.append(x[rng.integers(0, len(x), (min(step, replicates - at), len(x)))].mean(axis=1))
        means = np.sort(np.concatenate(means), axis=0)
        r, centre = len(means), x.mean(axis=0)
        lo, hi = means[int(alpha / 2 * r)], means[min(int((1 - alpha / 2) * r), r - 1)]
        p = ((np.abs(means - centre) >= np.abs(centre)).sum(axis=0) + 1) / (r + 1)
        keys = {b: [pdf[b].iloc[0]] * len(values) for b in by}
        return pd.DataFrame(keys | {"metric": values, "estimate": centre, "lo": lo, "hi": hi, "p": p, "n": [len(x)] * len(values)})

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "metric string, estimate double, lo double, hi double, p double, n long"])
    rows = df.select(*by, unit, *[F.col(v).cast("double").alias(v) for v in values])
    return rows.groupBy(*by).applyInPandas(run, schema)


def same_units(a: DataFrame, b: DataFrame, unit: str) -> DataFrame:
    """Units that only one side has, with the side: empty if a pair is complete."""
    both = a.select(unit).distinct().withColumn("_a", F.lit(True)).join(b.select(unit).distinct().withColumn("_b", F.lit(True)), unit, "full")
    return both.where("_a is null or _b is null").select(unit, F.when(F.col("_a"), "left").otherwise("right").alias("side"))


def ranks_with_ties(df: DataFrame, by: list[str], value: str) -> Column:
    """Mean rank, the greatest value first, within by."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(F.desc(value))) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0
