"""Retrieval probes: what share of a question's gold documents different ways of asking find.

Every probe lists its queries with the depth each is read to, and one BM25 search answers all of them; the corpus is split
once for a pass. questions (question_id, question, type), passages (doc_id, title, text), gold (question_id, doc_id,
title, place, support: array of sentences); questions of fewer than two gold documents take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import bm25, fusion, lineage, postings

#: A gain over the single query that a report marks, and names that a follow-up asks for at most.
MARKED_GAIN, NAMES = 0.05, 4


def fetch(passages: DataFrame | postings.Index, asked: DataFrame) -> DataFrame:
    """passages, or an index of them; asked (question_id, arm, k, query, depth, any more) with doc_id and rank: a row for each document found within the
    depth. The same query of a question is searched once."""
    named = asked.withColumn("_q", F.sha2(F.concat_ws("\x1f", F.col("question_id").cast("string"), "query"), 256))
    depth = named.agg(F.max("depth")).first()[0] or 0
    ranked = bm25.search(passages if isinstance(passages, postings.Index) else passages.select("doc_id", "text"), named.select("_q", "query").distinct(), int(depth), query_id="_q", query_text="query")
    return named.join(ranked.drop("score"), "_q").where(F.col("rank") <= F.col("depth")).drop("_q", "query", "depth")


def fetch_beside(index: postings.Index, asked: DataFrame, questions: DataFrame) -> DataFrame:
    """fetch() of queries that are query and the question together. Questions have as many of these as they have titles, so documents are scored
    once for a question and then for what a query adds."""
    named = asked.withColumn("_q", F.sha2(F.concat_ws("\x1f", F.col("question_id").cast("string"), "query"), 256))
    each = named.groupBy("_q", "question_id", "query").agg(F.max("depth").alias("depth")).join(questions.select("question_id", F.coalesce("question", F.lit("")).alias("question")), "question_id")
    ranked = bm25.search_beside(index, each, "_q", "query", "question", "depth")
    return named.join(ranked.drop("score"), "_q").where(F.col("rank") <= F.col("depth")).drop("_q", "query", "depth")


def _half(k: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(k / 2)).cast("int")


def _asked(df: DataFrame, arm: str, query: Column, depth: Column) -> DataFrame:
    return df.select("question_id", F.lit(arm).alias("arm"), "k", query.alias("query"), depth.cast("int").alias("depth"))


def several(gold: DataFrame) -> DataFrame:
    """gold of questions with two or more documents."""
    return gold.withColumn("_n", F.count("*").over(Window.partitionBy("question_id"))).where("_n > 1").drop("_n")


def scored(found: DataFrame, gold: DataFrame, questions: DataFrame, arms: list[str], ks: list[int]) -> DataFrame:
    """(question_id, type, arm, k, n_gold, n_found, n_hidden, n_hidden_found): for every question with gold, also where an arm
    found nothing. gold has hidden."""
    spark = gold.sparkSession
    every = gold.select("question_id", "doc_id", "hidden").crossJoin(F.broadcast(spark.createDataFrame([(a, k) for a in arms for k in ks], "arm string, k int")))
    hits = found.select("question_id", "arm", "k", "doc_id").distinct().withColumn("hit", F.lit(True))
    both = every.join(hits, ["question_id", "arm", "k", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    per = both.groupBy("question_id", "arm", "k").agg(F.count("*").alias("n_gold"), F.count_if("hit").alias("n_found"), F.count_if("hidden").alias("n_hidden"), F.count_if(F.col("hidden") & F.col("hit")).alias("n_hidden_found"))
    return per.join(questions.select("question_id", "type"), "question_id")


def report(per: DataFrame) -> DataFrame:
    """(level, name, arm, k, n, recall, all_gold, n_hidden, hidden_recall, gain, marked): by type, by whether gold is hidden, and over all.
    gain is recall over that of the arm single."""
    kind = F.when(F.col("n_hidden") > 0, "hidden").otherwise("named")
    rows = per.withColumn("_l", F.explode(F.array(*[F.struct(F.lit(a).alias("level"), b.alias("name")) for a, b in (("type", F.col("type")), ("stratum", kind), ("all", F.lit("all")))]))).select("*", "_l.*")
    out = rows.groupBy("level", "name", "arm", "k").agg(
        F.count("*").alias("n"), F.avg(F.col("n_found") / F.col("n_gold")).alias("recall"), F.avg((F.col("n_found") == F.col("n_gold")).cast("int")).alias("all_gold"), F.count_if(F.col("n_hidden") > 0).alias("n_hidden"),
        F.avg(F.when(F.col("n_hidden") > 0, F.col("n_hidden_found") / F.col("n_hidden"))).alias("hidden_recall"),
    )
    single = F.max(F.when(F.col("arm") == "single", F.col("recall"))).over(Window.partitionBy("level", "name", "k"))
    return out.withColumn("gain", F.col("recall") - single).withColumn("marked", F.col("gain") > MARKED_GAIN)


def _hidden(gold: DataFrame, questions: DataFrame) -> DataFrame:
    return several(gold).join(questions.select("question_id", "question"), "question_id").withColumn("hidden", ~F.contains(text.norm(F.col("question")), text.norm(F.col("title"))))


def bridges(passages: DataFrame, questions: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Rows of scored() for single, two_pass, oracle, span and names.

    A first pass of half the budget; then oracle asks for each hidden title with the question, two_pass only for those a
    document of the first pass holds, span for the gold sentences the first pass found, names for names in these that
    neither the question nor a title found so far has. An arm with nothing to ask is the single query.
    """
    spark = questions.sparkSession
    budgets = F.broadcast(spark.createDataFrame([(k,) for k in ks], "k int"))
    known = lineage.cut(_hidden(gold, questions))
    asking = questions.join(known.select("question_id").distinct(), "question_id", "left_semi").crossJoin(budgets)
    index = bm25.index(passages)  # both passes search it
    single = lineage.cut(fetch(index, _asked(asking, "single", F.col("question"), F.col("k"))))
    first = single.where(F.col("rank") <= _half(F.col("k"))).select("question_id", "k", "doc_id")
    texts = lineage.cut(first.join(passages, "doc_id").select("question_id", "k", "doc_id", "title", text.norm(F.col("text")).alias("body")))

    hidden = known.where("hidden").select("question_id", "question", "title").crossJoin(budgets)
    seen = hidden.join(texts.select("question_id", "k", "body"), ["question_id", "k"]).where(F.contains("body", text.norm(F.col("title")))).select("question_id", "k", "title").distinct()
    asked = []
    for arm, rows in (("oracle", hidden), ("two_pass", hidden.join(seen, ["question_id", "k", "title"], "left_semi"))):
        n = F.count("*").over(Window.partitionBy("question_id", "k"))
        asked.append(_asked(rows, arm, F.col("title"), F.greatest(F.lit(1), F.floor(_half(F.col("k")) / n))))
    spans = known.join(first, ["question_id", "doc_id"]).select("question_id", "question", "k", "place", "support").groupBy("question_id", "question", "k").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "support"))), lambda x: x["support"])).alias("spans")).where(F.size("spans") > 0)
    asked.append(_asked(spans, "span", F.array_join("spans", " "), _half(F.col("k"))))
    titles = texts.groupBy("question_id", "k").agg(F.collect_list(text.norm(F.col("title"))).alias("titles"))
    named = spans.join(titles, ["question_id", "k"]).withColumn("names", fusion.candidate_names(F.col("spans")))
    fresh = F.filter("names", lambda c: ~F.contains(text.norm(F.col("question")), text.norm(c)) & ~F.exists("titles", lambda t: F.contains(t, text.norm(c))))
    named = named.withColumn("names", fresh).where(F.size("names") > 0)
    names = lineage.cut(_asked(named, "names", F.array_join(F.slice("names", 1, NAMES), " "), F.greatest(F.lit(1), F.col("k") - _half(F.col("k")))))

    follow = asked[0]
    for a in asked[1:]:
        follow = follow.unionByName(a)
    follow = lineage.cut(follow)  # with the question
    found = fetch_beside(index, follow, questions).unionByName(fetch(index, names)).select("question_id", "arm", "k", "doc_id")
    started = follow.unionByName(names).select("question_id", "arm", "k").distinct()
    arms = spark.createDataFrame([(a,) for a in ("two_pass", "oracle", "span", "names")], "arm string")
    idle = asking.select("question_id", "k").crossJoin(F.broadcast(arms)).join(started, ["question_id", "arm", "k"], "left_anti")
    rows = single.select("question_id", "arm", "k", "doc_id").unionByName(found)
    rows = rows.unionByName(started.join(first, ["question_id", "k"]).select("question_id", "arm", "k", "doc_id"))
    rows = rows.unionByName(idle.join(single.drop("arm", "rank"), ["question_id", "k"]).select("question_id", "arm", "k", "doc_id"))
    return scored(rows, known, questions, ["single", "two_pass", "oracle", "span", "names"], ks)


def named_titles(passages: DataFrame, questions: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Rows of scored() for single, and oracle: a follow-up for each gold title that the question names as a whole phrase (the first
    if it names none), with an equal share of the budget for each query, the question's own among them."""
    known = several(gold).join(questions.select("question_id", "question"), "question_id").withColumn("hidden", ~text.title_mentioned(F.col("title"), F.col("question")))
    known = lineage.cut(known)
    w = Window.partitionBy("question_id")
    follow = known.withColumn("_none", F.min(F.col("hidden").cast("int")).over(w) == 1).withColumn("_first", F.min("place").over(w))
    follow = follow.where(~F.col("hidden") | (F.col("_none") & (F.col("place") == F.col("_first"))))
    budgets = F.broadcast(questions.sparkSession.createDataFrame([(k,) for k in ks], "k int"))
    follow = follow.select("question_id", "question", "title", F.count("*").over(w).alias("n")).crossJoin(budgets)
    share = F.greatest(F.lit(1), F.floor(F.col("k") / (F.col("n") + 1)))
    whole = follow.select("question_id", "question", "k", share.alias("share")).distinct()
    asked = _asked(whole, "single", F.col("question"), F.col("k")).unionByName(_asked(whole, "oracle", F.col("question"), F.col("share")))
    asked = asked.unionByName(_asked(follow, "oracle", F.concat_ws(" ", "title", "question"), share))
    return scored(fetch(passages, lineage.cut(asked)), known, questions, ["single", "oracle"], ks)


def iterated(passages: DataFrame, plans: DataFrame, gold: DataFrame, ks: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows of scored() for single, naive (each sub-question an equal share) and oracle (the second one with the first gold title, half
    each), and (arm, k, n, hop2): how often later sub-questions alone find the second gold document.

    plans: (question_id, question, type, sub_questions), at least one."""
    known = lineage.cut(_hidden(gold, plans))
    budgets = F.broadcast(plans.sparkSession.createDataFrame([(k,) for k in ks], "k int"))
    # second is of the next place, whatever numbers places have
    order = known.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "title"))).alias("g"))
    rows = plans.join(order, "question_id").crossJoin(budgets).withColumns({"first_title": F.get("g", F.lit(0))["title"], "second": F.get("g", F.lit(1))["doc_id"]})
    n = F.size("sub_questions")
    pieces = rows.select("*", F.posexplode("sub_questions").alias("hop", "sub"))
    with_hop = lambda df, arm, query, depth, hop: _asked(df, arm, query, depth).withColumn("hop", F.lit(hop))
    naive = pieces.select("question_id", F.lit("naive").alias("arm"), "k", F.col("sub").alias("query"), F.greatest(F.lit(1), F.floor(F.col("k") / n)).cast("int").alias("depth"), F.least("hop", F.lit(1)).alias("hop"))
    half = F.floor(F.col("k") / 2)
    asked = with_hop(rows, "single", F.col("question"), F.col("k"), 0).unionByName(naive)
    asked = asked.unionByName(with_hop(rows, "oracle", F.get("sub_questions", F.lit(0)), half, 0))
    asked = asked.unionByName(with_hop(rows, "oracle", F.concat_ws(" ", "first_title", F.coalesce(F.get("sub_questions", F.lit(1)), "question")), half, 1))
    found = lineage.cut(fetch(passages, lineage.cut(asked)))
    late = found.where("hop = 1").select("question_id", "arm", "k", F.col("doc_id").alias("second")).distinct().withColumn("hit", F.lit(1))
    arms = plans.sparkSession.createDataFrame([("naive",), ("oracle",)], "arm string")
    hop2 = rows.select("question_id", "k", "second").crossJoin(F.broadcast(arms)).join(late, ["question_id", "arm", "k", "second"], "left").groupBy("arm", "k").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("hop2"))
    return scored(found, known, plans, ["single", "naive", "oracle"], ks), hop2
