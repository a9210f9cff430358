"""Hashed bootstraps against plain Python, and the reports made of them."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import reports, stats


def word(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def plain_pick(salt, place, draw, n):
    x = salt ^ word(f"0|p|{place}") ^ word(f"0|d|{draw}")
    x = ((x ^ x >> 16) * 0x85EBCA6B) % 2**32
    x = ((x ^ x >> 13) * 0xC2B2AE35) % 2**32
    return ((x ^ x >> 16) * n) >> 32


def plain_draws(rows, replicates):
    """rows (stratum, v, w) -> (stratum, draw): sums over the picks among the stratum's rows in order."""
    by = defaultdict(list)
    for s, *x in rows:
        by[s].append(tuple(x))
    out = {}
    for s, units in by.items():
        units.sort()
        for d in range(replicates):
            chosen = [units[plain_pick(word(s), p, d, len(units))] for p in range(len(units))]
            out[s, d] = (len(chosen), *(round(sum(c), 6) for c in zip(*chosen, strict=True)))
    return out


@pytest.mark.parametrize("places, vectors", [(1 << 16, 1 << 20), (7, 1 << 20), (16, 5), (1000, 3)])
def test_draws_are_the_same_however_they_are_dealt(spark, monkeypatch, places, vectors):
    monkeypatch.setattr(stats, "PLACES", places)
    monkeypatch.setattr(stats, "VECTORS", vectors)
    rng = np.random.default_rng(3)
    rows = [(s, float(rng.integers(0, 9)), float(rng.integers(0, 2))) for s, n in (("a", 40), ("b", 1), ("c", 25)) for _ in range(n)]
    df = spark.createDataFrame([(s, i, v, w) for i, (s, v, w) in enumerate(rows)], "s string, u long, v double, w double")
    got = {(r.s, r.draw): (r.n, round(r.v, 6), round(r.w, 6)) for r in stats.hashed_draws(df, ["s"], "u", ["v", "w"], 12).collect()}
    assert got == plain_draws(rows, 12)


def test_equal_values_are_one_row_and_a_large_stratum_goes_by_blocks(spark):
    df = spark.range(200_000).select(F.lit("s").alias("s"), "id", (F.col("id") % 2).alias("v"))
    got = stats.hashed_draws(df, ["s"], "id", ["v"], 40).collect()
    assert {r.n for r in got} == {200_000} and len(got) == 40
    means = np.array([r.v / r.n for r in got])
    assert abs(means.mean() - 0.5) < 5e-4 and 5e-4 < means.std() < 2e-3  # binomial: 1.1e-3


def test_strata_are_drawn_independently(spark):
    df = spark.range(60).select((F.col("id") % 2).cast("string").alias("s"), "id", F.floor(F.col("id") / 2).cast("double").alias("v"))
    rows = stats.hashed_draws(df, ["s"], "id", ["v"], 2000).collect()
    by = {s: np.array([r.v for r in sorted(rows, key=lambda r: r.draw) if r.s == s]) for s in "01"}
    assert abs(np.corrcoef(by["0"], by["1"])[0, 1]) < 0.1


def test_no_rows_and_null_values(spark):
    empty = spark.createDataFrame([], "s string, u long, v double")
    assert stats.hashed_draws(empty, ["s"], "u", ["v"], 5).count() == 0
    df = spark.createDataFrame([("x", 1, None), ("x", 2, 4.0), (None, 3, 1.0)], "s string, u long, v double")
    got = stats.hashed_draws(df, ["s"], "u", ["v"], 8).collect()
    assert {r.s for r in got} == {"x", None} and {r.n for r in got if r.s == "x"} == {2} and {r.v for r in got if r.s == "x"} <= {0.0, 4.0, 8.0}


def test_interval_of_draws(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(10_000)], "g string, v double")
    r = stats.draw_interval(df, ["g"], "v").first()
    assert (r.lo, r.hi, r.n) == (250.0, 9750.0, 10_000)
    with pytest.raises(ValueError, match="alpha"):
        stats.draw_interval(df, ["g"], "v", 1.0)


# --- reports ---------------------------------------------------------------------------------------------------------


def arms(spark, rows):
    return spark.createDataFrame(rows, "arm string, unit long, f double")


def test_contrasts_share_their_picks(spark):
    rows = [(a, u, float(u * k)) for a, k in (("base", 0), ("one", 1), ("two", 2)) for u in range(30)]
    means, draws = reports.effects(arms(spark, rows), "arm", "unit", ["f"], "base", 50)
    assert {(r.arm, r.estimate, r.n_units) for r in means.collect()} == {("one", 14.5, 30), ("two", 29.0, 30)}
    by = {a: {r.draw: r.v for r in draws.collect() if r.arm == a} for a in ("one", "two")}
    assert len(by["one"]) == 50 and all(by["two"][d] == pytest.approx(2 * v) for d, v in by["one"].items())


def test_arms_must_have_the_same_units(spark):
    rows = [("base", 1, 0.0), ("base", 2, 0.0), ("one", 1, 1.0)]
    with pytest.raises(Exception, match="different units"):
        reports.contrasts(arms(spark, rows), "arm", "unit", ["f"], "base").collect()


def test_family_with_one_unit_and_adjusted_values(spark):
    rows = [("base", 1, 0.0), ("one", 1, 1.0), ("two", 1, 0.0)]
    got = {r.arm: r for r in reports.family(arms(spark, rows), "arm", "unit", ["f"], "base", "f", 99).collect()}
    assert (got["one"].lo, got["one"].estimate, got["one"].hi, got["one"].n_units) == (1.0, 1.0, 1.0, 1)
    assert (got["two"].p, got["one"].p, got["one"].adjusted, got["two"].adjusted) == (1.0, 0.01, 0.02, 1.0)


def test_rates_leave_out_null_groups_and_units_without_calls(spark):
    calls = spark.createDataFrame([("r", 1, 1, 2), ("r", 2, 0, 0), (None, 3, 1, 1)], "run string, q long, a long, b long")
    got = reports.clustered_rates(calls, ["run"], "q", {"m": (F.sum("a"), F.sum("b"))}, 20).collect()
    assert [(r.run, r.metric, r.estimate, r.lo, r.hi, r.n_units, r.n) for r in got] == [("r", "m", 0.5, 0.5, 0.5, 1, 2)]
    assert reports.clustered_rates(calls.where("false"), ["run"], "q", {"m": (F.sum("a"), F.sum("b"))}, 20).count() == 0


def test_ranks_split_ties(spark):
    draws = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("c", 0, 0.0), ("a", 1, 2.0), ("b", 1, 1.0), ("c", 1, 0.0)], "name string, draw int, v double")
    got = {r.name: r for r in reports.rank_report(draws, "name", "v").collect()}
    assert (got["a"].mean_rank, got["a"].p_most, got["b"].mean_rank, got["b"].p_most, got["c"].p_least) == (1.25, 0.75, 1.75, 0.25, 1.0)
    assert (got["a"].rank_lo, got["a"].rank_hi) == (1.0, 1.5)
    assert {(r.name, r.other): r.p_greater for r in reports.pairwise(draws, "name", "v").collect()}["a", "b"] == 0.5


def test_too_many_names_are_refused(spark, monkeypatch):
    monkeypatch.setattr(reports, "MOST_NAMES", 2)
    draws = spark.createDataFrame([(n, 0, 1.0) for n in "abc"], "name string, draw int, v double")
    with pytest.raises(ValueError, match="names"):
        reports.pairwise(draws, "name", "v")
    with pytest.raises(Exception, match="too many arms"):
        reports.contrasts(arms(spark, [(a, 1, 0.0) for a in "abc"]), "arm", "unit", ["f"], "a").collect()


@pytest.mark.parametrize("n, kinds, base", [(5000, 3, 0), (5000, 300, 0), (9000, 9000, 0), (6000, 5, 900), (300_000, 20, 0), (300_000, 9000, 70)])
def test_sums_of_picks_are_the_same_by_bounds_by_sorting_and_by_tables(monkeypatch, n, kinds, base):
    rng = np.random.default_rng(7)
    values, counts = np.stack([np.arange(kinds) * 0.25, rng.integers(0, 9, kinds)], axis=1), np.full(kinds, (n - base) // kinds // (2 if base else 1))
    counts[-1] += 0 if base else n - counts.sum()
    units, ends = np.repeat(values, counts, axis=0), base + counts.sum()
    at = np.array([[plain_pick(5, p, d, n) for p in range(4096)] for d in range(3)])
    inside = (at >= base) & (at < ends)
    want = np.array([units[a[i] - base].sum(axis=0) for a, i in zip(at, inside, strict=True)])
    for sorted_, laid_out in (((1 << 13), (1 << 18, 1 << 23)), (0, (1 << 30, 1 << 30)), (0, (0, 0))):
        monkeypatch.setattr(stats, "_SORTED", sorted_)
        monkeypatch.setattr(stats, "_LAID_OUT", laid_out)
        sums, n_in = stats.drawn_sums(values, counts, n, base, (0, 4096), 3, salt=5)
        assert np.allclose(sums, want, rtol=1e-12, atol=0) and n_in.tolist() == inside.sum(axis=1).tolist()


def test_chunks_of_places_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(stats, "PLACES", 100)
    plans, kept = [], stats.lineage.cut
    monkeypatch.setattr(stats.lineage, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or kept(df))
    made = stats.hashed_draws(spark.range(1000).select("id", (F.col("id") % 2).alias("v")), [], "id", ["v"], 4)
    assert made.agg(F.sum("n")).first()[0] == 4000
    assert "REPARTITION_BY_NUM" in plans[-1]  # else the few rows would be one task's, and so all draws


def test_what_is_sent_to_tasks_grows_with_units_only(spark, monkeypatch):
    """Not with different values times chunks of places."""
    monkeypatch.setattr(stats, "PLACES", 10)
    frame, taken = type(spark.range(1)), []
    kept = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, *by: taken.append(df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]) or kept(df, *by))
    for n in (400, 1600):
        rows = [("s", i, float(i * i), float(i % 7)) for i in range(n)]
        df = spark.createDataFrame(rows, "s string, u long, v double, w double")
        got = {(r.s, r.draw): (r.n, round(r.v, 6), round(r.w, 6)) for r in stats.hashed_draws(df, ["s"], "u", ["v", "w"], 3).collect()}
        assert got == plain_draws([(s, v, w) for s, _, v, w in rows], 3)
    assert taken[1] < 5 * taken[0] and taken[1] < 1600 * 400


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("laid_out", [1 << 30, 0])
def test_values_are_taken_two_at_a_time(monkeypatch, width, laid_out):
    monkeypatch.setattr(stats, "_SORTED", 0)
    monkeypatch.setattr(stats, "_LAID_OUT", (laid_out, laid_out))
    rng = np.random.default_rng(5)
    values, counts = rng.integers(0, 1 << 40, (300, width)).astype(float), rng.integers(1, 4, 300)
    values[7, 0] = np.inf
    n, base = int(counts.sum()) + 50, 20
    units = np.repeat(values, counts, axis=0)
    at = np.array([[plain_pick(5, p, d, n) for p in range(n)] for d in range(3)])
    inside = (at >= base) & (at < base + len(units))
    sums, n_in = stats.drawn_sums(values, counts, n, base, (0, n), 3, salt=5)
    assert np.array_equal(sums, [units[a[i] - base].sum(axis=0) for a, i in zip(at, inside, strict=True)]) and n_in.tolist() == inside.sum(axis=1).tolist()


def test_values_laid_out_unit_by_unit_need_no_bounds(monkeypatch):
    """Of millions of different values they would take longer, for each chunk of places, and more memory than the values."""
    monkeypatch.setattr(stats, "_least_words", None)
    values = np.stack([np.arange(20_000.0), np.ones(20_000)], axis=1)
    sums, n_in = stats.drawn_sums(values, np.ones(20_000, np.int64), 20_000, 0, (0, 5000), 2)
    assert sums[:, 1].tolist() == n_in.tolist() == [5000, 5000] and sums[0, 0] == sum(plain_pick(0, p, 0, 20_000) for p in range(5000))
