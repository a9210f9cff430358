"""Queries over the corpus: documents are passages, benchmark items are questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import anchors, bm25, corpus, fusion
from .registry import query, read

_TOKENS = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+')"
_SENTENCES = "list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda s: trim(s)), lambda s: s <> '')"

_BM25 = rf"""
WITH tk AS MATERIALIZED (SELECT doc_id, {_TOKENS} AS ts FROM documents),
tok AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tk),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tk),
sc AS (SELECT item_id, doc_id, round(sum(times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc)
"""


def _ranked(spark: SparkSession, sf_dir: str, k: int, **options) -> DataFrame:
    return bm25.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k, **options)


@query(_BM25 + "SELECT item_id, rank::INTEGER AS rank, doc_id, round(score, 4) AS score FROM ranked WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return _ranked(spark, sf_dir, 10).withColumn("score", F.round("score", 4))


@query(
    _BM25.replace("FROM benchmark)", "FROM (SELECT item_id, regexp_extract(text, '[^ ]+', 0) AS text FROM benchmark))")
    + """, short AS (SELECT item_id FROM ranked GROUP BY item_id HAVING count(*) < 12),
z AS (SELECT item_id, doc_id, 0.0::DOUBLE AS score FROM short CROSS JOIN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 24) ANTI JOIN ranked USING (item_id, doc_id)),
a AS (SELECT item_id, doc_id, score FROM ranked UNION ALL SELECT * FROM z)
SELECT item_id, rank::INTEGER AS rank, doc_id, round(score, 4) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM a) WHERE rank <= 12"""
)
def bm25_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words as queries; what doesn't match fills up."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", "[^ ]+", 0).alias("text"))
    return bm25.search(read(spark, sf_dir, "documents"), items, 12, fill=True).withColumn("score", F.round("score", 4))


@query(f"SELECT doc_id, len({_TOKENS})::INTEGER AS length, list_unique({_TOKENS})::INTEGER AS n_terms FROM documents")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and distinct terms of each document."""
    t = text.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("length"), F.size(F.array_distinct(t)).alias("n_terms"))


@query(f"""
WITH tf AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term)
SELECT term, df, cf, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 6) AS idf FROM tf""")
def term_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and corpus frequency and idf of every term."""
    docs = read(spark, sf_dir, "documents")
    tf = bm25.term_frequencies(docs, "doc_id", text.tokens(F.col("text")))
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    n = docs.agg(F.count("*").alias("n"))  # one row
    return stats.crossJoin(F.broadcast(n)).select("term", "df", "cf", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(rf"""
SELECT lang, sum(len({_TOKENS}))::BIGINT AS n_tokens, sum(len(regexp_extract_all(lower(text), '[a-z0-9]+')))::BIGINT AS n_ascii, count(*) AS n_docs
FROM documents GROUP BY lang""")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by language, of both tokenizers."""
    c = F.col("text")
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.size(text.tokens(c))).alias("n_tokens"), F.sum(F.size(text.ascii_tokens(c))).alias("n_ascii"), F.count("*").alias("n_docs"))


@query()
def exact_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Unicode-exact tokenizer's normal form."""
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.exact_tokens("text"), " ").alias("norm"))


@query("""
SELECT key, doc_id, source_no FROM (
  SELECT md5(text) AS key, doc_id, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS source_no,
    row_number() OVER (PARTITION BY md5(text) ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) AS rn FROM documents) WHERE rn = 1""")
def corpus_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents first, then others; the first of each text stays."""
    docs = read(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "doc_id", "lang")
    both = corpus.first_wins([docs.where("lang = 'en'"), docs.where("lang <> 'en' or lang is null")], "key", ["doc_id"])
    return both.select("key", "doc_id", "source_no")


@query("SELECT text AS title, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def corpus_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that would be refused as titles."""
    return corpus.duplicates(read(spark, sf_dir, "documents").select(F.col("text").alias("title")), "title")


@query("SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS corpus_idx FROM documents")
def corpus_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the corpus, without one task that sees all rows."""
    return corpus.numbered(read(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"])


@query(f"""
WITH s AS (SELECT doc_id, {_SENTENCES} AS ss FROM documents)
SELECT doc_id, pos AS pos, ss[pos + 1] AS sentence, len(ss[pos + 1]) AS chars FROM (SELECT doc_id, ss, unnest(range(len(ss)))::INTEGER AS pos FROM s)""")
def unnest_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays that run in parallel, side by side."""
    docs = read(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("sentence"))
    both = docs.withColumn("chars", F.transform("sentence", lambda s: F.length(s).cast("long")))
    return corpus.unnest(both, "sentence", "chars")


@query(f"SELECT doc_id, trim(array_to_string({_SENTENCES}, ' ')) AS passage FROM documents")
def passage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences joined to a passage."""
    return read(spark, sf_dir, "documents").select("doc_id", text.passage_text(text.sentences(F.col("text"))).alias("passage"))


_INDEX = rf"""
WITH s AS (SELECT doc_id, {_SENTENCES} AS ss FROM documents),
x AS (SELECT doc_id, i AS sent_id, ss[i + 1] AS text FROM (SELECT doc_id, ss, unnest(range(len(ss))) AS i FROM s)),
idx AS (SELECT doc_id, sent_id, text, array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+'), ' ') AS norm FROM x)
"""


@query(_INDEX + "SELECT * FROM idx WHERE norm <> '' AND doc_id IN (SELECT doc_id FROM labels)")
def sentence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the labelled documents."""
    only = read(spark, sf_dir, "labels").select("doc_id").distinct()
    return corpus.sentence_index(read(spark, sf_dir, "documents"), "doc_id", text.sentences(F.col("text")), only)


@query("""
WITH r AS (SELECT doc_id AS id, doc_id // 1000 AS block, sha256(doc_id::VARCHAR || chr(31) || text) AS h FROM documents),
b AS (SELECT block, sha256(string_agg(h, chr(10) ORDER BY id, h)) AS h, count(*) AS n FROM r GROUP BY block),
c AS (SELECT block // 1000 AS block, sha256(string_agg(h, chr(10) ORDER BY block)) AS h, sum(n) AS n FROM b GROUP BY block // 1000),
d AS (SELECT block // 1000 AS block, sha256(string_agg(h, chr(10) ORDER BY block)) AS h, sum(n) AS n FROM c GROUP BY block // 1000)
SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(h, chr(10) ORDER BY block)) AS sha256 FROM d""")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of all documents in order."""
    return corpus.fingerprint(read(spark, sf_dir, "documents"), "doc_id", "text")


_MENTION = r"""
WITH b AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+'), ' ') || ' ' AS q FROM benchmark),
t AS (SELECT DISTINCT array_to_string(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[\p{L}\p{N}]+'), ' ') AS base, title
  FROM (SELECT regexp_extract(text, '^[^ \n]+') AS title FROM documents) WHERE title <> '')
"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of each document, as a title."""
    title = F.regexp_extract("text", "^[^ \n]+", 0)
    return read(spark, sf_dir, "documents").select(title.alias("title")).where("title <> ''").distinct()


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, title) where the item names the title, found by equal runs of tokens rather than by all pairs."""
    t = _titles(spark, sf_dir).withColumn("base", text.norm(F.col("title"))).where("base <> ''").withColumn("n", F.size(F.split("base", " ")))
    words = text.tokens(F.col("text"))
    items = read(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    sizes = [r[0] for r in t.select("n").distinct().collect()]  # titles have a few tokens
    run_of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
    runs = F.array_distinct(F.flatten(F.array(*[run_of(n) for n in sizes or [1]])))
    return items.select("item_id", F.explode(runs).alias("base")).join(t, "base").select("item_id", "title")


@query(_MENTION + "SELECT item_id, title FROM b JOIN t ON contains(q, ' ' || base || ' ') WHERE base <> ''")
def title_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that an item names."""
    return _mentions(spark, sf_dir)


@query(
    _MENTION
    + """, m AS (SELECT item_id, count(*) AS n FROM b JOIN t ON contains(q, ' ' || base || ' ') WHERE base <> '' GROUP BY item_id)
SELECT CASE WHEN coalesce(n, 0) > 0 THEN 'fully_named' ELSE 'hidden_bridge' END AS stratum, count(*) AS n_items FROM b LEFT JOIN m USING (item_id) GROUP BY 1"""
)
def strata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by whether they name what they are about."""
    named = _mentions(spark, sf_dir).select("item_id").distinct().withColumn("named", F.lit(True))
    stratum = F.when(F.col("named"), "fully_named").otherwise("hidden_bridge")
    return read(spark, sf_dir, "benchmark").join(named, "item_id", "left").groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n_items"))


@query(
    _BM25
    + """, a AS (SELECT item_id, list(doc_id ORDER BY rank) AS anchor FROM ranked WHERE rank <= 10 GROUP BY item_id),
t AS (SELECT item_id, list(doc_id ORDER BY doc_id) AS task FROM ranked WHERE rank <= 20 AND rank % 2 = 0 GROUP BY item_id),
h AS (SELECT item_id, anchor, task, anchor[1:7] AS head, list_filter(task, lambda x: NOT list_contains(anchor[1:7], x))[1:3] AS more FROM a JOIN t USING (item_id)),
c AS (SELECT item_id, head || more AS c1, anchor, task FROM h),
d AS (SELECT item_id, c1 || list_filter(anchor, lambda x: NOT list_contains(c1, x)) AS c2, task FROM c)
SELECT item_id, array_to_string((c2 || list_filter(task, lambda x: NOT list_contains(c2, x)))[1:10], ',') AS fused FROM d"""
)
def fuse_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of each item, fused with quotas."""
    ranked = _ranked(spark, sf_dir, 20)
    gather = lambda keep, by: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct(F.col(by).alias("k"), F.col("doc_id").alias("d"))))), lambda x: x["d"])
    both = ranked.groupBy("item_id").agg(gather(F.col("rank") <= 10, "rank").alias("anchor"), gather(F.col("rank") % 2 == 0, "doc_id").alias("task"))
    return both.select("item_id", F.array_join(fusion.fuse(F.col("anchor"), F.col("task")).cast("array<string>"), ",").alias("fused"))


_SECOND = r"coalesce(list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda x: trim(x)), lambda x: x <> '')[2], text)"


@query(
    f"WITH one AS ({_BM25} SELECT item_id, doc_id FROM ranked WHERE rank <= 7), two AS ({_BM25.replace('FROM benchmark)', f'FROM (SELECT item_id, {_SECOND} AS text FROM benchmark))')} SELECT item_id, doc_id, rank FROM ranked WHERE rank <= 10)"
    + """, n AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank FROM two ANTI JOIN one USING (item_id, doc_id))
SELECT item_id, doc_id, rank::INTEGER AS rank FROM n WHERE rank <= 3"""
)
def two_pass_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second pass with a query of its own, the item's second sentence, over-fetched by what the first pass saw; both
    passes search one index, of the terms that either asks for."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    follow = items.withColumn("text", F.coalesce(F.get(text.sentences(F.col("text")), F.lit(1)), "text"))
    asked = items.unionByName(follow).select(F.explode(text.tokens(F.col("text"))).alias("term"))
    index = bm25.index(docs, asked=asked)
    seen = bm25.search(index, items, fusion.HOP1)
    return fusion.second_pass(bm25.search(index, follow, fusion.K), seen, "item_id", "doc_id").select("item_id", "doc_id", "rank")


@query(
    _BM25
    + """, g AS (SELECT item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
n AS (SELECT item_id, count(*) AS gold FROM g GROUP BY item_id),
k AS (SELECT unnest([5, 10, 20, 50])::INTEGER AS k),
h AS (SELECT n.item_id, k.k, n.gold, count(r.doc_id) AS hits FROM n CROSS JOIN k LEFT JOIN g ON g.item_id = n.item_id LEFT JOIN ranked r ON r.item_id = g.item_id AND r.doc_id = g.doc_id AND r.rank <= k.k GROUP BY ALL)
SELECT k, count(*) AS n_items, round(avg(hits / gold), 6) AS recall, round(avg((hits = gold)::INTEGER), 6) AS all_gold FROM h GROUP BY k"""
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of gold documents among the best k; gold documents hold the item's text."""
    gold = gold_documents(spark, sf_dir)
    ranked = _ranked(spark, sf_dir, 50)
    per = gold.join(ranked, ["item_id", "doc_id"], "left").crossJoin(F.broadcast(spark.createDataFrame([(5,), (10,), (20,), (50,)], "k int")))
    hits = per.groupBy("item_id", "k").agg(F.count("*").alias("gold"), F.count_if(F.col("rank") <= F.col("k")).alias("hits"))
    return hits.groupBy("k").agg(F.count("*").alias("n_items"), F.round(F.avg(F.col("hits") / F.col("gold")), 6).alias("recall"), F.round(F.avg((F.col("hits") == F.col("gold")).cast("int")), 6).alias("all_gold"))


def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id) of documents that hold the text of an item."""
    return anchors.held_by(read(spark, sf_dir, "benchmark"), "item_id", "text", read(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which items."""
    return gold_documents(spark, sf_dir)


@query(
    _INDEX
    + """, g AS (SELECT doc_id, sent_id, CASE sent_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN text || '?' ELSE text END AS text, sent_id + CASE WHEN sent_id % 4 = 3 THEN 100000 ELSE 0 END AS sid FROM idx WHERE norm <> '') ,
st AS (SELECT CASE WHEN i.text IS NULL THEN 'missing' WHEN i.text = g.text THEN 'equal' WHEN trim(regexp_replace(g.text, '\\s+', ' ', 'g')) = trim(regexp_replace(i.text, '\\s+', ' ', 'g')) THEN 'equivalent' ELSE 'different' END AS status
  FROM g LEFT JOIN (SELECT * FROM idx WHERE norm <> '') i ON i.doc_id = g.doc_id AND i.sent_id = g.sid)
SELECT status, count(*) AS n FROM st GROUP BY status"""
)
def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How gold sentences, some of them changed, resolve to indexed ones."""
    index = corpus.sentence_index(read(spark, sf_dir, "documents"), "doc_id", text.sentences(F.col("text")))
    way, t = F.col("sent_id") % 4, F.col("text")
    changed = F.when(way == 1, F.replace(t, F.lit(" "), F.lit("  "))).when(way == 2, F.concat(t, F.lit("?"))).otherwise(t)
    gold = index.select("doc_id", (F.col("sent_id") + F.when(way == 3, 100000).otherwise(0)).alias("sent_id"), changed.alias("text"))
    return corpus.gold_coverage(gold, index, "doc_id").groupBy("status").agg(F.count("*").alias("n"))


@query(_BM25 + "SELECT item_id, string_agg('[' || rank || '] ' || doc_id || ': ' || text, chr(10) ORDER BY rank) AS passages FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY item_id")
def render_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passages, looked up and rendered whole."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return corpus.rendered(bm25.lookup(_ranked(spark, sf_dir, 5), docs, "doc_id"), "item_id", "rank", "doc_id", "body")


@query()
def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in every document's sentences."""
    return read(spark, sf_dir, "documents").select("doc_id", fusion.candidate_names(text.sentences(F.col("text"))).alias("names"))


@query()
def followup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each item's best document would lead to next."""
    best = _ranked(spark, sf_dir, 1).join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    found = best.join(items, "item_id").withColumn("names", fusion.candidate_names(text.sentences(F.col("text"))))
    title = F.array(F.regexp_extract("text", "^[^ \n]+", 0))
    return found.select("item_id", "doc_id", fusion.followup(F.col("names"), F.col("question"), title).alias("query"))


_ANSWERS = r"""
WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
pg AS (SELECT item_id, array_to_string(w[1:8], ' ') AS pred, array_to_string(w[CASE WHEN item_id % 3 = 0 THEN 1 ELSE 4 END:CASE WHEN item_id % 3 = 0 THEN 8 ELSE 11 END], ' ') AS gold FROM w),
p1 AS (SELECT item_id, translate(lower(pred), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '') AS p, translate(lower(gold), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '') AS g FROM pg)
"""
for _ in range(3):
    _ANSWERS += f", p{_ + 2} AS (SELECT item_id, " + ", ".join(rf"regexp_replace({c}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{N}}_])', '\1 \3', 'g') AS {c}" for c in "pg") + f" FROM p{_ + 1})"
_ANSWERS += r", n AS (SELECT item_id, trim(regexp_replace(p, '\s+', ' ', 'g')) AS p, trim(regexp_replace(g, '\s+', ' ', 'g')) AS g FROM p4)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", " ")
    gold = F.when(F.col("item_id") % 3 == 0, F.slice(w, 1, 8)).otherwise(F.slice(w, 4, 8))
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(w, 1, 8), " ").alias("pred"), F.array_join(gold, " ").alias("gold"))


@query(_ANSWERS + "SELECT item_id, p AS pred, g AS gold FROM n")
def answer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of answers."""
    return _answers(spark, sf_dir).select("item_id", text.answer_norm(F.col("pred")).alias("pred"), text.answer_norm(F.col("gold")).alias("gold"))


@query(
    _ANSWERS
    + """, x AS (SELECT item_id, p, g, list_filter(string_split(p, ' '), lambda s: s <> '') AS a, list_filter(string_split(g, ' '), lambda s: s <> '') AS b FROM n),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda u: u = t)), len(list_filter(b, lambda u: u = t))))), 0) AS c FROM x)
SELECT item_id, (p = g)::INTEGER::DOUBLE AS em, CASE WHEN c = 0 OR ((p IN ('yes', 'no', 'noanswer') OR g IN ('yes', 'no', 'noanswer')) AND p <> g) THEN 0.0 ELSE round(2.0 * c / (len(a) + len(b)), 9) END::DOUBLE AS f1 FROM o"""
)
def em_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match and token F1."""
    p, g = F.col("pred"), F.col("gold")
    return _answers(spark, sf_dir).select("item_id", text.exact_match(p, g).alias("em"), F.round(text.token_f1(p, g), 9).alias("f1"))
