import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import near_dedup, shingles


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_sets(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    """doc_id -> (set size, component) by comparing all pairs that share a shingle."""
    sets = {d: brute_sets(t) for d, t in rows}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, s in sets.items():
        for b in {b for x in s for b in where[x] if b > a}:
            both = len(s & sets[b])
            if 100 * both >= percent * (len(s) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def run(spark, rows, schema="doc_id long, text string"):
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, schema)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 200]))
        rows.append(base)
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


def test_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 8)
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(70):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(copy)))
    assert run(spark, rows) == brute(rows)


def test_nulls_blanks_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Same Words"), (5, "same\x0bwords"), (6, "same words more"), (7, "x " * 30000), (7, "x " * 30000), (None, "same words"), (9, "a b"), (10, "a b")]
    got = run(spark, rows)
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[5] == (1, 4) and got[6] == (1, 6)
    assert got[7] == (1, 7) and got[None] == (1, None)
    assert got[9] == (1, 9) and got[10] == (1, 10)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == {}
    schema = "doc_id long, text string, component string, fp string, kept string, node string, blocks string"
    rows = [(i, t, "a", "b", "c", "d", "e") for i, t in [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g")]]
    assert run(spark, rows, schema) == {1: (2, 1), 2: (2, 1), 3: (1, 3)}


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, "g", None), (3, "g", None), (None, "g", "t"), (4, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = near_dedup.keep_one(spark, df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a b c d e f", "s"), (3, "g", None), (None, "g", "t"), (4, None, "t")], key=str)


def test_signature_is_circulant():
    h = np.arange(50, dtype=np.uint64)
    sig = shingles.signature(h, 16)
    at = (shingles.mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(int)
    pi = np.random.default_rng(20_240_501).permutation(shingles.POSITIONS)
    assert sig.tolist() == [min(pi[(p + k) % shingles.POSITIONS] for p in at) for k in range(16)]


@pytest.mark.parametrize("share", [0.85, 0.95])
def test_bands_find_similar_sets(share):
    rng, hits = np.random.default_rng(3), 0
    for _ in range(100):
        h = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        other = np.concatenate([h[: int(400 * 2 * share / (1 + share)) + 1], rng.integers(0, 1 << 63, 29, dtype=np.uint64)])
        keys = [shingles.band_keys(shingles.signature(x, near_dedup.BANDS * near_dedup.ROWS), near_dedup.BANDS) for x in (h, other)]
        hits += bool((keys[0] == keys[1]).any())
    assert hits == 100


@pytest.mark.parametrize("percent", [50, 80, 84, 85, 100])
def test_banding_seldom_misses_a_pair_at_the_threshold(percent):
    bands, rows = near_dedup.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= 2.6e-4


def test_pairs_from_80_percent_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        base = [f"w{rng.randrange(5000)}" for _ in range(204)]
        copy = list(base)
        for at in (50, 100, 150, 190)[: rng.randrange(3, 5)]:
            copy[at] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark, docs, percent=80).collect()}
    assert got == brute(rows, 80) and sum(d != c for d, (_, c) in got.items()) > 100
    assert sum(d != c for d, (_, c) in brute(rows).items()) < 100


def test_ids_with_several_texts_join_all_their_groups(spark):
    a, b = "one two three four five six", "red green blue white black grey"
    got = near_dedup.near_duplicates(spark, spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (11, "alone")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (11, 11, True)]


def test_large_groups_of_several_originals_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 6)
    rng = random.Random(7)
    base, rows = [f"w{rng.randrange(900)}" for _ in range(160)], []
    for i in range(150):  # a chain: every text keeps most of the one before and loses its beginning at times
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(base[rng.randrange(3) :])))
    assert run(spark, rows) == brute(rows)


def test_a_long_chain_is_compared_in_linear_work(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("id as doc_id", "explode(array(id, id + 1)) as key", "cast(100 as long) as n_shingles")
    tmp = near_dedup.shared.Scratch(spark, "chain")
    keys = tmp.cut(rows.where(f"key between 1 and {n - 1}"), "keys")
    placed = near_dedup.dealt(tmp, keys, 85)
    within = {r.block: r["count"] for r in placed.groupBy("block").count().collect()}
    pairs, members = near_dedup.crossing(tmp, keys, placed, spark.createDataFrame([], "node long, component long"))
    block = {r.doc_id: r.block for r in members.collect()}
    size, met = Counter(block.values()), {(r.i, r.j) for r in pairs.collect()}
    compared = sum(k * k for k in within.values()) + sum(size[i] * size[j] for i, j in met)
    assert sum(within.values()) == len(block) == n and compared <= 20 * n
    # each pair that shares a bucket is in one block or in a pair of blocks
    assert all(tuple(sorted((block[i], block[i + 1]))) in met for i in range(n - 1))


def test_one_of_repeated_rows_stays_whatever_the_order(spark):
    rows = [(1, "a b c d e f", i) for i in range(5)] + [(1, "other text that stays as well", 9), (2, "a b c d e f", 0), (None, "x", 1), (None, "x", 1)]
    want = [(None, 1), (None, 1), (1, 0), (1, 9)]
    for order in (rows, rows[::-1]):
        got = near_dedup.keep_one(spark, spark.createDataFrame(order, "doc_id long, text string, kept int").repartition(3)).collect()
        assert sorted(((r.doc_id, r.kept) for r in got), key=lambda r: (r[0] is not None, r)) == want
