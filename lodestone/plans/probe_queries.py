"""Retrieval probes over the corpus: eight items in a row are a question of several parts, documents that hold one of them
its gold, and a document's first two words its title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import probes
from .corpus_queries import _BM25, gold_documents
from .registry import query, read

_KS = [10, 20]


def _probe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    passages = read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"^\S+\s+\S+", 0).alias("title"), "text")
    question = F.floor(F.col("item_id") / 8).cast("long")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"])
    items = read(spark, sf_dir, "benchmark").where("text is not null").groupBy(question.alias("question_id")).agg(parts.alias("parts"))
    kind = F.when(F.col("question_id") % 2 == 0, "bridge").otherwise("comparison")
    questions = items.select("question_id", F.array_join("parts", " ").alias("question"), kind.alias("type"), F.slice("parts", 1, 3).alias("sub_questions"))
    held = gold_documents(spark, sf_dir).select(question.alias("question_id"), "doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id"))
    gold = held.join(passages, "doc_id").select("question_id", "doc_id", "title", place.alias("place"), F.slice(text.sentences(F.col("text")), 1, 2).alias("support"))
    return passages, questions, gold


def _report(per: DataFrame) -> DataFrame:
    return probes.report(per).withColumns({c: F.round(c, 6) for c in ("recall", "all_gold", "hidden_recall", "gain")})


@query()
def retrieval_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of five ways of asking, by type, by hidden titles, and over all."""
    return _report(probes.bridges(*_probe(spark, sf_dir), _KS))


def _norm(c: str) -> str:
    return rf"array_to_string(regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+'), ' ')"


@query(
    rf"""
WITH qs AS (SELECT item_id // 8 AS question, string_agg(text, ' ' ORDER BY item_id) AS qtext FROM benchmark WHERE text IS NOT NULL GROUP BY 1),
gd AS (SELECT DISTINCT b.item_id // 8 AS question, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
g0 AS (SELECT question, doc_id, qtext, regexp_extract(text, '^\S+\s+\S+', 0) AS title, row_number() OVER (PARTITION BY question ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY question) AS ng FROM gd JOIN qs USING (question) JOIN documents USING (doc_id)),
g1 AS (SELECT *, {_norm(r"regexp_replace(title, '\s*\([^()]*\)\s*$', '')")} AS nt FROM g0 WHERE ng > 1),
g AS (SELECT *, NOT (nt <> '' AND contains(' ' || {_norm("qtext")} || ' ', ' ' || nt || ' ')) AS hidden FROM g1),
f AS (SELECT question, qtext, title, place, count(*) OVER (PARTITION BY question) AS n FROM (SELECT *, bool_and(hidden) OVER (PARTITION BY question) AS none FROM g) WHERE NOT hidden OR (none AND place = 1)),
asked AS (SELECT question || '|0' AS item_id, question, any_value(qtext) AS text, any_value(n) AS n, true AS own FROM f GROUP BY question UNION ALL SELECT question || '|' || place, question, title || ' ' || qtext, n, false FROM f),
"""
    + _BM25.replace("\nWITH ", "", 1).replace("FROM benchmark)", "FROM asked)")
    + """, ks AS (SELECT unnest([10, 20]) AS k),
found AS (SELECT DISTINCT question, arm, k, doc_id FROM (SELECT question, doc_id, rank, k, n, own, unnest(['single', 'oracle']) AS arm FROM ranked JOIN asked USING (item_id) CROSS JOIN ks)
  WHERE (arm = 'single' AND own AND rank <= k) OR (arm = 'oracle' AND rank <= greatest(1, k // (n + 1)))),
per AS (SELECT question, arm, k, count(*) AS gold, count(found.doc_id) AS hits, sum(hidden::INTEGER) AS nh, count(found.doc_id) FILTER (hidden) AS hh FROM g CROSS JOIN ks CROSS JOIN (SELECT unnest(['single', 'oracle']) AS arm) LEFT JOIN found USING (question, arm, k, doc_id) GROUP BY ALL),
l AS (SELECT *, unnest([{'level': 'type', 'name': CASE WHEN question % 2 = 0 THEN 'bridge' ELSE 'comparison' END}, {'level': 'stratum', 'name': CASE WHEN nh > 0 THEN 'hidden' ELSE 'named' END}, {'level': 'all', 'name': 'all'}]) AS x FROM per),
o AS (SELECT x.level AS level, x.name AS name, arm, k, count(*) AS n, avg(hits / gold) AS recall, avg((hits = gold)::INTEGER) AS all_gold, count(*) FILTER (nh > 0) AS n_hidden, avg(CASE WHEN nh > 0 THEN hh / nh END) AS hidden_recall FROM l GROUP BY ALL)
SELECT o.level, o.name, o.arm, o.k, o.n, round(o.recall, 6) AS recall, round(o.all_gold, 6) AS all_gold, o.n_hidden, round(o.hidden_recall, 6) AS hidden_recall, round(o.recall - s.recall, 6) AS gain, o.recall - s.recall > 0.05 AS marked
FROM o JOIN o s ON s.level = o.level AND s.name = o.name AND s.k = o.k AND s.arm = 'single'"""
)
def title_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over all and over hidden gold with follow-ups for the titles that a question names."""
    return _report(probes.named_titles(*_probe(spark, sf_dir), _KS))


@query()
def iterative_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sub-questions find, with and without the first gold title put into the second."""
    passages, questions, gold = _probe(spark, sf_dir)
    plans = questions.where(F.size("sub_questions") > 0)
    per, hop2 = probes.iterated(passages, plans, gold, _KS)
    return _report(per).where("level = 'all'").drop("level", "name", "marked").join(hop2.select("arm", "k", F.round("hop2", 6).alias("hop2")), ["arm", "k"], "left")
