"""Shared postings against adding up every posting."""

import glob
import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, postings
from lodestone.plans import registry


def corpus(seed, count):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 200}"
    return [" ".join(word() for _ in range(rng.randint(0, 50))) for _ in range(count)]


def exhaustive(docs, queries, k):
    tok = lambda s: re.findall(r"\w+", (s or "").lower())
    bags = [(i, Counter(tok(t))) for i, t in docs]
    sized = [sum(b.values()) for (_, t), (_, b) in zip(docs, bags, strict=True) if t is not None]
    avg = sum(sized) / len(sized) if sum(sized) else 1.0
    df = Counter(t for _, b in bags for t in b)
    idf = {t: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    out = {}
    for q, text in queries:
        asked = Counter(tok(text))
        scored = []
        for i, b in bags:
            s = sum(c * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / avg)) * idf[t] for t, c in asked.items() if b[t])
            if s:
                scored.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def tables(spark, docs, queries):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(6, "doc_id")
    return d, spark.createDataFrame(queries, "item_id long, text string")


def by_query(rows, queries):
    got = {q: [] for q, _ in queries}
    for r in rows.orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.doc_id, round(r.score, 6)))
    return got


@pytest.mark.parametrize("whole", [True, False])
def test_search_equals_the_exhaustive_sum(spark, monkeypatch, whole):
    monkeypatch.setattr(postings, "BLOCK_POSTINGS", 300)
    docs, queries = [*enumerate(corpus(1, 250)), (300, None), (301, "")], [*enumerate(corpus(2, 15)), (90, "unknown words"), (91, None), (92, "w1 w1 w150")]
    d, q = tables(spark, docs, queries)
    index = bm25.index(d) if whole else d
    assert by_query(bm25.search(index, q, 7), queries) == exhaustive(docs, queries, 7)


def test_blocks_that_cannot_matter_are_skipped(spark, monkeypatch):
    """A rare word stands in the documents of one block, and a frequent one everywhere."""
    monkeypatch.setattr(postings, "BLOCK_POSTINGS", 400)
    monkeypatch.setattr(postings, "SLICE", 100)
    docs = [(i, f"common filler{i % 9} " + ("rare rare" if i < 20 else "")) for i in range(3000)]
    d, q = tables(spark, docs, [(1, "rare common")])
    index = bm25.index(d)
    assert by_query(bm25.search(index, q, 10), [(1, "")]) == exhaustive(docs, [(1, "rare common")], 10)
    assert index.last["pairs"] > 10 and index.last["scored"] <= postings.FIRST


def test_one_index_serves_all_searches(spark):
    docs = [*enumerate(corpus(3, 60))]
    d, _ = tables(spark, docs, [])
    index = bm25.index(d)
    for seed in (4, 5):
        queries = [*enumerate(corpus(seed, 5))]
        assert by_query(bm25.search(index, tables(spark, docs, queries)[1], 3), queries) == exhaustive(docs, queries, 3)
    few = tables(spark, docs, [(0, "w199 w198 w197")])[1]
    filled = bm25.search(index, few, 60, fill=d)
    assert filled.count() == 60 and [r.score > 0 for r in filled.orderBy("rank").collect()] == sorted([r.score > 0 for r in filled.collect()], reverse=True)


def test_queries_in_parts_and_ids_of_text(spark, monkeypatch):
    monkeypatch.setattr(postings, "QUERY_BYTES", 300)
    docs, queries = [*enumerate(corpus(6, 50))], [*enumerate(corpus(7, 12))]
    d, q = tables(spark, docs, queries)
    named = bm25.search(d.select(F.format_string("d%03d", "doc_id").alias("doc_id"), "text"), q, 4)
    got = by_query(named.withColumn("doc_id", F.substring("doc_id", 2, 3).cast("long")), queries)
    assert got == exhaustive(docs, queries, 4)


def test_empty_tables_and_no_results_wanted(spark):
    d, q = tables(spark, [(1, "a b")], [(1, "a")])
    assert bm25.search(d.where("false"), q, 3).count() == bm25.search(d, q.where("false"), 3).count() == bm25.search(d, q, 0).count() == 0


def test_row_groups_of_an_index_are_small(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 28))
    docs = spark.range(30_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.hash("id", i).cast("string")), " ").alias("text"))
    index = bm25.index(docs)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
    for table in ("slices", "blocks"):
        files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{index.path}/{table}/*.parquet")]
        groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
        assert len(groups) > 3 and max(g.num_rows for g in groups) <= 4 and max(g.total_byte_size for g in groups) < 16 << 20  # a reader holds all rows of a group


def test_python_works_on_small_batches_of_texts(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 28))
    spark.range(4000, numPartitions=1).select("id", F.repeat(F.lit("word "), 1000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    sizes = registry.read(spark, str(tmp_path), "t").mapInPandas(lambda frames: (f.assign(n=len(f))[["n"]].head(1) for f in frames), "n long")
    assert max(r.n for r in sizes.collect()) * 5000 <= 8 << 20


@pytest.mark.parametrize("query_bytes", [1 << 20, 400])
def test_queries_beside_a_shared_text_equal_searches_of_both(spark, monkeypatch, query_bytes):
    monkeypatch.setattr(postings, "BLOCK_POSTINGS", 300)
    monkeypatch.setattr(postings, "QUERY_BYTES", query_bytes)
    docs = [*enumerate(corpus(8, 250)), (300, None), (301, "")]
    texts = [*corpus(9, 3), "unknown", "", "w199"]
    queries = [(i, own, texts[i % len(texts)], i % 9) for i, own in enumerate([*corpus(10, 12), "w199 w198", "w1 w1", "nothing known", None, "w150"] * 2)]
    d, _ = tables(spark, docs, [])
    q = spark.createDataFrame(queries, "item_id long, text string, shared string, depth int")
    got = by_query(bm25.search_beside(bm25.index(d), q, "item_id", "text", "shared", "depth"), queries_ := [(i, f"{own or ''} {shared}") for i, own, shared, _ in queries])
    every = exhaustive(docs, queries_, 9)
    assert got == {i: every[i][:k] for i, _, _, k in queries}


def test_documents_of_one_id_count_each_beside_a_shared_text(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a c"), (None, "a b c"), (2, "a d d d d")], "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame([(1, "b", "a", 3), (2, "z", "a", 4)], "item_id long, text string, shared string, depth int")
    index = bm25.index(d)
    whole = bm25.search(index, q.select("item_id", F.concat_ws(" ", "text", "shared").alias("text")), 4).join(q.select("item_id", "depth"), "item_id").where("rank <= depth").drop("depth")
    assert sorted(map(str, bm25.search_beside(index, q, "item_id", "text", "shared", "depth").collect())) == sorted(map(str, whole.collect()))


def test_a_block_without_own_terms_that_matter_is_not_looked_at(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_POSTINGS", 400)
    monkeypatch.setattr(postings, "SLICE", 100)
    docs = [(i, f"common filler{i % 9} title{i} " + ("best" if i == 5 else "")) for i in range(3000)]
    d, _ = tables(spark, docs, [])
    q = spark.createDataFrame([(i, f"title{i} filler{i % 9}", "common best", 1) for i in range(200)], "item_id long, text string, shared string, depth int")
    index = bm25.index(d)
    assert bm25.search_beside(index, q, "item_id", "text", "shared", "depth").count() == 200
    assert 0 < index.last["scored"] <= 400 < index.last["pairs"] / 4
    assert bm25.search_beside(index, q.where("false"), "item_id", "text", "shared", "depth").count() == bm25.search_beside(bm25.index(d.where("false")), q, "item_id", "text", "shared", "depth").count() == 0
