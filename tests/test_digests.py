"""Digest trees, containment by anchors, allocation by bound, streams to files: against plain forms."""

import itertools
import random

import numpy as np
import pytest

from lodestone.operators import analytics, anchors, digests
from lodestone.plans import source_queries

# --- digest trees ----------------------------------------------------------------------------------------------------


def run_of(spark, rows):
    return digests.leaves(spark.createDataFrame(rows, "stage string, id long, v string"), "stage", ["id"], ["v"], size=4)


def collected(found):
    return {k: sorted(map(tuple, df.collect())) for k, df in found.items()}


def test_equal_runs_have_equal_roots_in_any_partitioning(spark):
    rows = [(s, i, f"v{i}") for s in "ab" for i in range(10)]
    a, b = run_of(spark, rows), run_of(spark, random.Random(1).sample(rows, len(rows))).repartition(5)
    assert all(not v for v in collected(digests.compare(a, b, ["v"])).values())


def test_only_what_differs_is_told(spark):
    rows = [(s, i, f"v{i}") for s in "abc" for i in range(10)]
    other = [(s, i, "new" if (s, i) == ("b", 5) else v) for s, i, v in rows if (s, i) != ("c", 9)] + [("d", 0, None)]
    found = collected(digests.compare(run_of(spark, rows), run_of(spark, other), ["v"]))
    assert found["run"] == [(30, 30)]
    assert found["stages"] == [("b", 10, 10), ("c", 10, 9), ("d", 0, 1)]
    assert found["batches"] == [("b", 1, 4, 4, 1), ("c", 2, 2, 1, 1), ("d", 0, 0, 1, 1)]
    assert found["records"] == [("b", 1, 1, "different"), ("c", 2, 1, "missing"), ("d", 0, 0, "unexpected")]


def test_order_counts_and_null_is_not_empty(spark):
    one = [("a", 0, "x"), ("a", 1, "y")]
    for other in ([("a", 0, "y"), ("a", 1, "x")], [("a", 0, "x"), ("a", 1, None)], [("a", 0, "x"), ("a", 1, "")]):
        assert collected(digests.compare(run_of(spark, one), run_of(spark, other), ["v"]))["batches"]
    assert collected(digests.compare(run_of(spark, [("a", 0, None)]), run_of(spark, [("a", 0, "")]), ["v"]))["records"] == [("a", 0, 0, "different")]
    assert collected(digests.compare(run_of(spark, one), run_of(spark, one).where("false"), ["v"]))["stages"] == [("a", 2, 0)]


# --- containment -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [True, False])
def test_documents_that_hold_items(spark, monkeypatch, few):
    from lodestone.operators import lineage

    if not few:
        monkeypatch.setattr(lineage, "BROADCAST_BYTES", 0)
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 80)))) for i in range(40)] + [(3, "a b again"), (50, None), (None, "ab ab ab ab ab ab")]
    whole = [t for _, t in docs if t and len(t) > 2]
    items = [(i, t[rng.randint(0, len(t) // 2) :][: rng.randint(1, 60)]) for i, t in enumerate(rng.choice(whole) for _ in range(30))] + [(90, ""), (91, None), (92, "not there at all, and longer than others"), (5, "b")]
    got = anchors.held_by(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    want = [(i, d) for i, s in items for d, t in docs if s is not None and t is not None and s in t]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


# --- allocation ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_allocation_equals_comparing_all(spark, seed):
    rng = np.random.default_rng(seed)
    roles, configs = ["a", "b", "c"], ["k0", "k1", "k2", "k3"]
    rows = [(r, c, float(e), (e + rng.normal(0, 0.5, 20)).tolist()) for r in roles for c in configs if rng.random() < 0.9 or c == "k0" for e in [rng.normal(0, 1)]]
    foot = {c: float(f) for c, f in zip(configs, rng.integers(1, 6, 4), strict=True)}
    by = {(r, c): (e, np.array(d)) for r, c, e, d in rows}
    margin, best = 1.0, []
    for names in itertools.product(configs, repeat=3):
        if all((r, c) in by for r, c in zip(roles, names, strict=True)):
            parts = [by[r, c] for r, c in zip(roles, names, strict=True)]
            lower = sorted(sum(d for _, d in parts).tolist())[0]
            if round(lower, 9) >= -margin:
                best.append((sum(foot[c] for c in set(names)), -round(sum(e for e, _ in parts), 9), len(set(names)), ",".join(names)))
    got = analytics.allocation(spark.createDataFrame(rows, "role string, configuration string, effect double, draws array<double>"), spark.createDataFrame(list(foot.items()), "configuration string, footprint double"), roles, margin).collect()
    assert [(r.footprint, -r.effect, r.n_configs, r.allocation) for r in got] == sorted(best)[:1]


# --- streams ---------------------------------------------------------------------------------------------------------


def test_streams_give_files_with_their_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(20).selectExpr("id % 5 as k").write.parquet(source)
    stream = spark.readStream.schema("k long").parquet(source).dropDuplicates(["k"])
    out = source_queries._run(stream, "append")
    assert sorted(r.k for r in out.collect()) == list(range(5)) and out.columns == ["k", "batch"]
    assert {f.rsplit("/", 2)[1] for f in out.inputFiles()} == {f"batch={r.batch}" for r in out.select("batch").distinct().collect()}
