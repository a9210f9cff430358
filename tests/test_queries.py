"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import catalogue
from lodestone.functions import text
from lodestone.plans import record_queries

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [normal(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, db, name):
    df = catalogue.queries()[name](spark, D)
    want = db.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr([normal(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(repr([normal(r[i]) for i in at]) for r in want.limit(10**9).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, name):
    df = catalogue.queries()[name](spark, D)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_every_sentence_is_a_span_to_map(spark):
    got = catalogue.queries()["normalize_spans_exact"](spark, D)
    index = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", F.explode(text.sentences(F.col("text"))))
    assert {r.doc_id: r.n_accepted + r.n_rejected for r in got.collect()} == {r.doc_id: r["count"] for r in index.groupBy("doc_id").count().collect()}


def test_dataflow_reads_ten_documents_a_step(spark):
    run = record_queries._flow(spark, D)
    run.answers()
    per = run.all_calls().where("role = 'extractor'").groupBy("question_id", "stage").count()
    assert per.agg(F.max("count")).first()[0] == 10


def test_exact_means_take_the_reference_number_of_draws(spark):
    got = catalogue.queries()["bootstrap_mean_numpy"](spark, D).collect()
    assert min(r.p for r in got) == pytest.approx(1 / 10_001)
