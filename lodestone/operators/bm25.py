"""BM25 retrieval: statistics, index, top-k search, in the logarithm-plus-one form of the inverse document frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import lineage, postings

K1, B = 1.5, 0.75


def term_frequencies(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, length, term, tf) with a row for each term of each document."""
    rows = docs.select(F.col(id_col), tokens.alias("_t")).select(id_col, F.size("_t").alias("length"), F.explode("_t").alias("term"))
    return rows.groupBy(id_col, "length", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def lengths(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n documents and their mean length, 1 if all are empty."""
    mean = F.avg(F.size(tokens))
    return docs.agg(F.count("*").alias("n"), F.when(mean > 0, mean).otherwise(1.0).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def index(docs: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", asked: DataFrame | None = None) -> postings.Index:
    """Postings of docs, written once, for as many searches as are needed; with asked (term), those of few terms only."""
    return postings.build(docs, doc_id, text.tokens(F.col(doc_text)), asked, K1, B)


def _terms(queries: DataFrame, query_id: str, query_text: str, name: str) -> DataFrame:
    """(name, term, times)."""
    return queries.select(F.col(query_id).alias(name), F.explode(text.tokens(F.col(query_text))).alias("term")).groupBy(name, "term").agg(F.count("*").alias("times"))


def _weighed(at: postings.Index, asked: DataFrame) -> DataFrame:
    """asked with weight instead of times; terms that the index lacks are left out."""
    known = asked.join(postings.frequencies(asked.sparkSession, at), "term")
    return known.select(asked.columns[0], "term", (F.col("times") * idf(F.lit(at.n), F.col("df"))).alias("weight"))


def search(docs: DataFrame | postings.Index, queries: DataFrame, k: int, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text", fill: DataFrame | bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query, by score to six digits, ties to the smaller id.

    docs: an index of them, or the documents, for which one of the queries' terms is made. A query token that occurs twice
    counts twice; unknown ones count nothing; a query without a known token, or k < 1, has no rows; rows of one query_id are
    one query. With fill (True, or the documents if docs is an index), a query with fewer than k matches gets the first documents
    that don't match, at score 0.
    """
    asked = lineage.cut(_terms(queries, query_id, query_text, "query"))
    at = docs if isinstance(docs, postings.Index) else index(docs, doc_id, doc_text, asked)
    spark = queries.sparkSession
    weights = _weighed(at, asked)
    hits = postings.search(spark, at, weights, max(k, 0)) if k > 0 else postings.search(spark, at, weights.limit(0), 1)
    hits = hits.select(F.col("query").alias(query_id), F.col("id").alias(doc_id), "score", "rank")
    if fill is False or k < 1:
        return hits.select(query_id, "rank", doc_id, "score")
    hits = lineage.cut(hits)
    matched = hits.groupBy(query_id).agg(F.count("*").alias("_n")).where(F.col("_n") < k).select(query_id)
    # k documents beyond the matches suffice: the first 2k hold k that don't match a query with fewer than k hits
    first = (docs if fill is True else fill).select(doc_id).orderBy(doc_id).limit(2 * k)
    zero = matched.crossJoin(F.broadcast(first)).join(hits.select(query_id, doc_id), [query_id, doc_id], "left_anti").withColumn("score", F.lit(0.0))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    every = hits.drop("rank").unionByName(zero)
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, "rank", doc_id, "score")


def search_beside(at: postings.Index, queries: DataFrame, query_id: str, query_text: str, shared_text: str, depth: str, doc_id: str = "doc_id") -> DataFrame:
    """(query_id, rank, doc_id, score) of queries that are query_text and shared_text together, each to its own depth, as search() gives them. Many
    queries may have one shared text, for which documents are scored once. queries: a row for each query_id; shared_text and depth not null."""
    rows = queries.where(F.col(depth) > 0).withColumn("_base", F.sha2(shared_text, 256))
    shared = _weighed(at, _terms(rows.select("_base", shared_text).distinct(), "_base", shared_text, "base"))
    own = _weighed(at, _terms(rows, query_id, query_text, "query"))
    asked = rows.select(F.col(query_id).alias("query"), F.col("_base").alias("base"), F.col(depth).cast("int").alias("k"))
    hits = postings.search_beside(queries.sparkSession, at, asked, own, shared)
    return hits.select(F.col("query").alias(query_id), "rank", F.col("id").alias(doc_id), "score")


def lookup(ranked: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """Passages of ranked keys, in no order but with their rank; keys without a passage are dropped."""
    return ranked.join(passages, key)
