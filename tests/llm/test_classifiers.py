import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import fitting, quality, toxicity
from lodestone.llm.queries import op1_quality, op5_toxicity
from lodestone.llm.shared import Scratch


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    chain = toxicity.Chain(np.exp(rng.normal(size=(2, 2))), np.exp(rng.normal(size=2)))
    sizes = [1, 5, 3, 7]
    emit, begins = np.exp(rng.normal(size=16)), np.zeros(16, bool)
    begins[np.cumsum([0, *sizes[:-1]])] = True
    want, at = [], 0
    for n in sizes:
        weight = np.zeros(n)
        total = 0
        for y in itertools.product((0, 1), repeat=n):
            w = chain.first[y[0]] * np.prod([emit[at + k] for k in range(n) if y[k]]) * np.prod([chain.step[a, b] for a, b in zip(y[:-1], y[1:], strict=True)])
            total += w
            weight += w * np.array(y)
        want += (weight / total).tolist()
        at += n
    for block in (2, 3, 128):
        toxicity.BLOCK, old = block, toxicity.BLOCK
        try:
            assert chain.marginals(emit, begins).tolist() == pytest.approx(want)
        finally:
            toxicity.BLOCK = old


def test_split_counts_words():
    texts = ["a b", None, "", "  \n", " x\x0b\ty ", "é ü", "\x0c"]
    coded, n = toxicity.split(pa.array(texts))
    assert n.tolist() == [2, 0, 0, 0, 2, 2, 0]
    assert coded.dictionary.take(coded.indices).to_pylist() == ["a", "b", "x", "y", "é", "ü"]


def toxic_rows(n=600, seed=3):
    rng = random.Random(seed)
    words, bad = [f"wort{i}" for i in range(200)], ["vile", "rotten", "awful"]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(5, 120))
        if i % 4 == 0:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(bad) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(text), "en", "s", 1, 9.0, "old"))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


DOCS = "doc_id long, text string, lang string, source string, toxic int, score double, spans string"
LABELS = "doc_id long, quality int, toxic int"


def test_op5_held_out_accuracy_and_spans(spark, tmp_path):
    rows, labels = toxic_rows()
    odd = [(9001, None, "en", "s", 1, 1.0, ""), (9002, "", "en", "s", 1, 1.0, ""), (None, "vile", "en", "s", 1, 1.0, ""), (9003, "wort1 " * 30000 + "VILE", None, None, None, None, None), (1, rows[1][1], "en", "s", 1, 9.0, "old")]
    spark.createDataFrame(rows + odd, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, None, None), (9001, None, None)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    text = {r[0]: r[1] for r in rows}
    found = {text[r.doc_id][s.start : s.end] for r in got if r.doc_id in text for s in r.spans}
    assert found and all(any(b in f for b in ("vile", "rotten", "awful")) for f in found)
    by_id = {r.doc_id: r for r in got}
    assert by_id[9001].score == by_id[9002].score < 0.3 and by_id[9001].spans == []
    assert by_id[9003].spans[-1].end == 6 * 30000 + 4
    again = op5_toxicity(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_op5_on_the_tables(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in op5_toxicity(spark, d).select("doc_id", "held_out", "predicted").collect() if r.held_out and r.doc_id in truth]
    hits = sum(r.predicted == 1 == truth[r.doc_id] for r in held)
    assert hits >= 0.9 * sum(truth[r.doc_id] for r in held) and hits >= 0.7 * sum(r.predicted for r in held)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1), (2, 1, 1)]])
def test_few_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1, 0.0, ""), (2, "c", "en", "s", 1, 0.0, "")], DOCS)
    ones = spark.createDataFrame(labels, LABELS)
    got = toxicity.score(spark, docs, toxicity.train(docs, ones)).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)
    judged = quality.judge(spark, docs, ones).collect()
    assert len(judged) == 2 and all(0 <= r.score <= 1 for r in judged)


def test_empty_documents(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 0)], LABELS)
    assert toxicity.score(spark, docs, toxicity.train(docs, labels)).count() == 0
    assert quality.judge(spark, docs, labels).count() == 0
    assert quality.keep_good(spark, docs, labels).columns == docs.columns


def test_logistic_finds_the_rates():
    x = np.array([[0.0]] * 100 + [[1.0]] * 100)
    y = np.array([1] * 20 + [0] * 80 + [1] * 70 + [0] * 30)
    w = fitting.logistic(x, y, ridge=1e-6)
    assert fitting.sigmoid(w[-1]) == pytest.approx(0.2, abs=1e-3) and fitting.sigmoid(w.sum()) == pytest.approx(0.7, abs=1e-3)


def test_sites_shrink_sparse_ones(spark):
    rows = [("a", "x", 0.9)] * 900 + [("a", "y", 0.1)] * 1 + [("b", "x", 0.3)] * 600 + [("c", "z", 0.0)] * 2
    got = {(r.host, r.path): r for r in quality.sites(spark.createDataFrame(rows, "host string, path string, p double"), Scratch(spark, "t")).collect()}
    base = got["a", "x"].base
    assert base == pytest.approx(sum(r[2] for r in rows) / len(rows))
    assert got["a", "x"].path_rate == pytest.approx(0.9, abs=0.02) and got["b", "x"].path_rate == pytest.approx(0.3, abs=0.02)
    assert 0.1 < got["a", "y"].path_rate < got["a", "y"].host_rate  # one document moves little
    assert 0.0 < got["c", "z"].host_rate < base


def test_op1_keeps_good_and_rejects_bad(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op1_quality(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    good, bad = [[r.keep for r in rows if truth.get(r.doc_id) == y] for y in (1, 0)]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_keep_good_agrees_with_judge_and_keeps_columns(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "n_chars", "n_chars as score", "lang as keep")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.keep_good(spark, docs, labels)
    want = {r.doc_id for r in quality.judge(spark, docs, labels, columns=["doc_id"]).collect() if r.keep}
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want


def test_giant_documents_leave_room_for_the_others(spark, monkeypatch):
    assert toxicity._fitting([3, 100, 4, 2, 1], 8) == [0, 2, 4] and toxicity._fitting([90, 70], 8) == [1] and toxicity._fitting([], 8) == []
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 50_000)
    rows, labels = toxic_rows(200)
    giants = [(7000 + i, f"vile {'wort7 ' * 20_000}", "en", "s", 1, 0.0, "") for i in range(4)]
    docs = spark.createDataFrame(rows + giants, DOCS)
    texts, y, _ = toxicity.sample(docs, spark.createDataFrame(labels + [(r[0], 1, 1) for r in giants], LABELS))
    assert max(map(len, texts)) < 50_000 and y.sum() == 50 and len(y) - y.sum() > 100


def by_numpy(rows, model):
    """Scores of op1 from its formulas, a row at a time."""
    z = np.array([model.logits(np.array([quality.features(r["text"])]))[0] for r in rows])
    p = 1 / (1 + np.exp(-z))
    host, path = [str(r["source"]) for r in rows], [(str(r["source"]), str(r["lang"])) for r in rows]
    total = lambda keys: {k: (sum(1 for x in keys if x == k), sum(v for x, v in zip(keys, p, strict=True) if x == k)) for k in set(keys)}
    hosts, paths = total(host), total(path)
    base = p.sum() / len(p)

    def strength(groups, above):
        spread = sum(n * (g / n - above(k)) ** 2 - above(k) * (1 - above(k)) for k, (n, g) in groups.items()) / max(sum(n for n, _ in groups.values()) - len(groups), 1)
        level = sum(n * above(k) * (1 - above(k)) for k, (n, _) in groups.items()) / sum(n for n, _ in groups.values())
        return min(max(level / max(spread, 1e-9) - 1, quality.LEAST_PRIOR), quality.MOST_PRIOR)

    k = strength(hosts, lambda _: base)
    host_rate = {h: (k * base + g) / (k + n) for h, (n, g) in hosts.items()}
    k = strength(paths, lambda s: host_rate[s[0]])
    path_rate = {s: (k * host_rate[s[0]] + g) / (k + n) for s, (n, g) in paths.items()}
    logit = lambda q: np.log(np.clip(q, 1e-4, 1 - 1e-4) / (1 - np.clip(q, 1e-4, 1 - 1e-4)))
    return [(z[i], host_rate[host[i]], path_rate[path[i]], 1 / (1 + np.exp(-(z[i] + logit(path_rate[path[i]]) - logit(base))))) for i in range(len(rows))]


def test_op1_against_its_formulas(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, 0), (1, "", "xx", None, 0), (1, "Some short text.", None, "one", 0)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs.select(*odd.columns).unionAll(odd).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.collect()
    want = sorted((str(r["doc_id"]), *(round(float(v), 6) for v in x), bool(x[3] >= quality.KEEP_FROM)) for r, x in zip(rows, by_numpy(rows, quality.train(docs, labels)), strict=True))
    got = sorted((str(r.doc_id), *(round(v, 6) for v in (r.doc_logit, r.host_rate, r.path_rate, r.score)), r.keep) for r in op1_quality(spark, str(tmp_path)).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[1:5] == pytest.approx(b[1:5], abs=3e-6) and a[5] == b[5]


def test_op1_on_labels_that_were_not_learnt(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.judge(spark, docs, labels.where("doc_id % 2 = 0"), columns=["doc_id"]).collect()
    truth = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    good, bad = [[r.keep for r in rows if truth.get(r.doc_id) == y] for y in (1, 0)]
    assert len(good) > 100 and len(bad) > 30 and sum(good) >= 0.98 * len(good) and sum(bad) <= 0.12 * len(bad)


def test_keep_good_judges_null_and_repeated_ids_by_row(spark):
    text = "This is a plain sentence of ordinary words. And here is another one, somewhat longer than it."
    docs = spark.createDataFrame([(None, text, "en", "s"), (1, text, "en", "s"), (1, text, "en", "s"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], LABELS)
    assert quality.keep_good(spark, docs, labels).where("text is not null").count() == 3


def test_rows_of_one_labelled_id_are_bounded(spark):
    from lodestone.llm import fitting

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "other") for i in range(2, 30)] + [(2, "other")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic long")
    for most in (5, 40):
        rows = fitting.labelled(docs, labels, "toxic", most).collect()
        assert all(sum(r.y == y for r in rows) <= most for y in (0, 1)) and len(rows) == len(set(rows))
    assert fitting.labelled(docs.where("doc_id > 1").distinct(), labels, "toxic", 40).count() == 28
