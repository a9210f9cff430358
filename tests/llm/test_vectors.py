import numpy as np
import pytest

from lodestone.llm import graphs, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, v string"


def usable(rows):
    return [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]


def cosines(rows):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    x = x / np.sqrt((x * x).sum(1))[:, None]
    return np.array(ids), x @ x.T


def made(n=900, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:160] = x[0] + 0.12 * rng.normal(size=(60, d))
    x[160:200] = x[1]
    x[200:220] = 3 * x[2]
    rows = [(int(i), [float(c) for c in v], 0, "s", "v") for i, v in zip(rng.permutation(n * 3)[:n], x, strict=True)]
    bad = [None, [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] + [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1), []]
    return rows + [(50 * (1000 + i), b, None, "s", "v") for i, b in enumerate(bad)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = made()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(d := str(tmp_path_factory.mktemp("v") / "e"))
    return d, rows


def check_nearest(got, rows, every=50, k=5):
    ids, c = cosines(usable(rows))
    at = {int(i): n for n, i in enumerate(ids)}
    hits = total = 0
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(c[at[r.query_id], at[r.vec_id]], abs=1e-12) and r.query_id != r.vec_id
    queries = [i for i in at if i % every == 0]
    assert set(by_query) == set(queries)
    for q in queries:
        want = sorted(((-c[at[q], n], i) for i, n in at.items() if i != q))[:k]
        mine = sorted(by_query[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(want) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += sum(r.score >= -want[-1][0] - 1e-9 for r in mine)
        total += len(want)
    return hits / total


def test_nearest_recall_against_brute_force(spark, folder):
    d, rows = folder
    assert check_nearest(vectors.nearest(spark, spark.read.parquet(d)).collect(), rows) >= 0.98


def test_nearest_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert check_nearest(vectors.nearest(spark, df).collect(), rows) >= 0.95


def test_nearest_ties_small_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 0, "", "") for i in range(12)] + [(0, [1.0, 2.0], 0, "", ""), (None, [1.0, 2.0], 0, "", ""), (50, [1.0], 0, "", "")], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in vectors.nearest(spark, df).orderBy("rank").collect()] == [(0, i, i) for i in range(1, 6)]
    two = df.where("vec_id in (0, 7)")
    assert [tuple(r) for r in vectors.nearest(spark, two).collect()] == [(0, 1, 7, pytest.approx(1.0))]
    assert vectors.nearest(spark, df.where("vec_id < 0")).count() == 0


def brute_links(rows, least=0.9):
    ids, c = cosines(usable(rows))
    linked = c >= least
    np.fill_diagonal(linked, False)
    out = {}
    for n, i in enumerate(ids):
        todo, seen = [n], {n}
        while todo:
            for m in np.flatnonzero(linked[todo.pop()]):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[int(i)] = (int(linked[n].sum()), int(min(ids[m] for m in seen)))
    return out | {r[0]: (0, r[0]) for r in rows if r[0] not in out}


def links(spark, df):
    got = vectors.near_duplicates(spark, df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    return {r.vec_id: (r.n_links, r.component_id) for r in got}


def test_links_match_brute_force(spark, folder):
    d, rows = folder
    got, want = links(spark, spark.read.parquet(d)), brute_links(rows)
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in want) >= 0.995 * len(want)


def test_links_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert links(spark, df) == brute_links(rows)


def test_links_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], 0, "", ""), (3, [1.0, 0.0], 0, "", ""), (1, [2.0, 0.0], 0, "", ""), (2, [0.0, 1.0], 0, "", ""), (None, [1.0, 0.0], 0, "", ""), (4, [1.0], 0, "", "")], SCHEMA)
    assert links(spark, df) == {3: (1, 1), 1: (1, 1), 2: (0, 2), None: (0, None), 4: (0, 4)}
    assert vectors.near_duplicates(spark, df).count() == 6
    assert links(spark, df.where("vec_id < 0")) == {}


def test_many_equal_directions_end(spark):
    x = np.tile(np.array([[0.6, 0.8]], np.float32), (300, 1))
    world = graphs.SmallWorld(x).build()
    assert len(world.within(x[:3], 0.9, 16)[0]) == 900


def test_huge_and_tiny_components():
    a = np.array([[1e200, 1e200], [1e-200, 2e-200]])
    assert vectors.cosine(a, a).tolist() == pytest.approx([1.0, 1.0])


def test_links_of_ids_with_several_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 0, "", ""), (2, [1.0, 0.0, 0.0], 0, "", ""), (1, [0.0, 1.0, 0.0], 0, "", ""), (7, [0.0, 1.0, 0.05], 0, "", ""), (9, [0.0, 0.0, 1.0], 0, "", "")], SCHEMA)
    got = vectors.near_duplicates(spark, df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (7, 1, 1), (9, 0, 9)]
    # 5 is a copy of 3 and also near 9, so 9 reaches 3
    df = spark.createDataFrame([(3, [1.0, 0.0], 0, "", ""), (5, [1.0, 0.0], 0, "", ""), (5, [0.0, 1.0], 0, "", ""), (9, [0.0, 1.0], 0, "", "")], SCHEMA)
    got = vectors.near_duplicates(spark, df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(3, 1, 3), (5, 1, 3), (5, 1, 3), (9, 1, 3)]


def test_links_of_a_dense_clump(spark):
    rng = np.random.default_rng(3)
    x = (np.eye(1, 8) + 0.05 * rng.normal(size=(3000, 8))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "", "") for i, v in enumerate(x)], SCHEMA).repartition(4)
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(axis=1))[:, None]
    want = (y @ y.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark, df).collect()}
    assert [got[i] for i in range(3000)] == [(int(n), 0) for n in want]


def test_joined_cells_are_few_and_join_all(spark):
    rng = np.random.default_rng(5)
    for share in (0.0, 0.005, 0.02, 0.3, 1.0):
        linked = rng.random((60, 90)) < share
        a, b = graphs.linked_groups(linked)
        assert linked[a, b].all()
        label = lambda i, j: dict(zip(*map(np.ndarray.tolist, graphs.forest(i, j + 60)), strict=True))
        assert label(a, b) == label(*np.nonzero(linked))


def test_visits_mark_each_pair_once():
    marks = graphs.Visits(10, 4)
    for _ in range(2):
        marks.begin()
        at = marks.fresh(np.array([0, 0, 1, 0, 3]), np.array([5, 5, 5, 6, 9]))
        assert sorted(zip(np.array([0, 0, 1, 0, 3])[at].tolist(), np.array([5, 5, 5, 6, 9])[at].tolist(), strict=True)) == [(0, 5), (0, 6), (1, 5), (3, 9)]
        assert len(marks.fresh(np.array([0, 2]), np.array([6, 6]))) == 1


def test_very_long_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5000))
    x[50:] = x[:10] + 0.01 * rng.normal(size=(10, 5000))
    df = spark.createDataFrame([(50 * i, v.tolist(), 1, 2, 3, 4) for i, v in enumerate(x)], "vec_id long, embedding array<double>, id int, v int, node int, n_links int")
    near = {r.query_id: r.vec_id for r in vectors.nearest(spark, df, k=1).collect()}
    assert len(near) == 60 and all(near[50 * i] == 50 * (50 + i) for i in range(10))
    assert sum(r.n_links for r in vectors.near_duplicates(spark, df).collect()) == 20


@pytest.mark.parametrize("scales", [[2.0**k for k in range(-20, 20)], [1.0, 3.0, 0.7, 1e-5, 12345.0]])
def test_parallel_vectors_go_by_their_ids(spark, scales):
    """All have one direction: cosines are 1 but for rounding, which decides in double precision."""
    rng = np.random.default_rng(5)
    one = rng.normal(size=16)
    rows = [(i, (one * scales[i % len(scales)]).tolist()) for i in range(400)]
    got = {}
    for r in vectors.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    v = np.array([x for _, x in rows])
    for q in range(0, 400, 50):
        score = vectors.cosine(np.repeat(v[q : q + 1], 400, axis=0), v)
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:5]
        assert got[q] == [(i, score[i]) for i in want]


def test_ties_wider_than_a_beam_are_all_ranked(spark):
    """More vectors than a beam holds differ by less than single precision tells."""
    rng = np.random.default_rng(6)
    one = rng.normal(size=8)
    rows = [(i, (one + rng.normal(size=8) * 1e-7).tolist()) for i in range(3000)]
    v = np.array([x for _, x in rows])
    got = vectors.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=500).collect()
    for q in range(0, 3000, 500):
        score = vectors.cosine(np.repeat(v[q : q + 1], 3000, axis=0), v)
        want = sorted((i for i in range(3000) if i != q), key=lambda i: (-score[i], i))[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
