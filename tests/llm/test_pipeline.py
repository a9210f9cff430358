from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline as C
from lodestone.llm import tokens
from lodestone.llm.queries import BYTE_BPE
from tests.llm.test_near_dedup import brute

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave."""
    folder, docs, out = tmp_path_factory.mktemp("p"), spark.read.parquet(f"{D}/documents.parquet"), {}
    for name, stage in C.STAGES:
        given = docs
        stage(spark, docs, D).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = given, docs
    return out


def test_stages_keep_the_columns(stages):
    for name, (given, gave) in list(stages.items())[:-1]:
        assert gave.columns == given.columns, name


def test_filters_keep_rows_as_they_are(stages, spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    for name, column, bad in (("quality", "quality", 0), ("toxicity", "toxic", 1)):
        given, gave = stages[name]
        before, after = Counter(map(tuple, given.collect())), Counter(map(tuple, gave.collect()))
        assert not after - before
        known = [i for i in {r[0] for r in before} if i in labels]
        kept = {r[0] for r in after}
        clean, rest = [[i in kept for i in known if (labels[i][column] == bad) == side] for side in (False, True)]
        assert sum(clean) >= 0.95 * len(clean) and sum(rest) <= 0.2 * len(rest), name


def test_one_of_each_group_stays(stages):
    given, gave = stages["near_dedup"]
    rows = [(r.doc_id, r.text) for r in given.collect()]
    assert sorted(r.doc_id for r in gave.collect()) == sorted(d for d, (_, c) in brute(rows, C.NEAR_PERCENT).items() if d == c)


def test_mix_and_tokens(stages):
    given, gave = stages["mixing"]
    before, after = {r.doc_id: r for r in given.collect()}, gave.collect()
    assert max(Counter(r.doc_id for r in after).values()) <= 3 and all(before[r.doc_id] == r for r in after)
    words = sum(len(r.text.split()) for r in before.values())
    assert sum(len(r.text.split()) for r in after) == pytest.approx(words, rel=0.1)
    last = stages["byte_bpe"][1].collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in after) and all(r.exact for r in last)
    for r in last[:50]:
        assert r.ids == tokens.byte_ids([before[r.doc_id].text], P.path(BYTE_BPE), P.PATTERN)[0].astype("<u4").tobytes()


def test_run_is_the_stages(stages, spark):
    got = C.run(spark, D)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, stages["byte_bpe"][1].collect()))


def test_odd_documents_and_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "s", 0, 1.0, "x"), (None, "a b c d e f g", "en", "s", 5, 1.0, "x"), (3, long, "en", "s", 5, 1.0, "x"), (3, long, "en", "s", 5, 1.0, "x"), (4, long, "en", "s", 5, 1.0, "x")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for k, (name, stage) in enumerate(C.STAGES):
            before = docs
            stage(spark, docs, D).write.parquet(path := f"{tmp_path}/{before.count()}-{k}-{name}")
            docs = spark.read.parquet(path)
            if k < len(C.STAGES) - 1:
                assert docs.columns == before.columns


def test_near_dedup_stage_links_from_80_percent(spark):
    base = [f"w{i}" for i in range(104)]
    near, far = list(base), [f"v{i}" for i in range(104)]
    near[30] = near[60] = "changed"  # 90 of 110 shingles
    rows = [(i, " ".join(w)) for i, w in enumerate((base, near, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in C.distinct(spark, docs, D).collect())
    assert kept == sorted(d for d, (_, c) in brute(rows, 80).items() if d == c) == [0, 2]
    assert sum(d == c for d, (_, c) in brute(rows).items()) == 3
