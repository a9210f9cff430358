"""The second pass of retrieval: what its index holds."""

from pyspark.sql import functions as F

from lodestone import catalogue
from lodestone.functions import text
from lodestone.operators import bm25, fusion, postings

D = "/root/testdata/sf0.001"


def test_one_index_of_the_terms_asked_for(spark, monkeypatch):
    made, build = [], postings.build
    monkeypatch.setattr(postings, "build", lambda *a, **k: made.append(build(*a, **k)) or made[-1])
    got = sorted(map(tuple, catalogue.queries()["two_pass_retrieve"](spark, D).collect()))
    assert len(made) == 1
    docs, items = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "benchmark"))
    asked = {r.t for r in items.select(F.explode(text.tokens(F.col("text"))).alias("t")).collect()}
    held = {r.term for r in postings.frequencies(spark, made[0]).collect()}
    assert held and held <= asked
    follow = items.withColumn("text", F.coalesce(F.get(text.sentences(F.col("text")), F.lit(1)), "text"))
    index = bm25.index(docs)  # of all terms
    want = fusion.second_pass(bm25.search(index, follow, fusion.K), bm25.search(index, items, fusion.HOP1), "item_id", "doc_id")
    assert got and got == sorted(map(tuple, want.select("item_id", "doc_id", "rank").collect()))
