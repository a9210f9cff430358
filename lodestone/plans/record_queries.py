"""Queries over conversations and events as call records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outputs, text
from ..operators import answers, records, spans
from . import corpus_queries, dataflow
from .registry import query, read

_NORM = r"array_to_string(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+'), ' ')"
_BARE = r"""trim(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), e' \t\r\n.,;:!?"\'`()[]{{}}')"""
_NONE = ", ".join("'" + s.replace("'", "''") + "'" for s in text.NO_ANSWER)
_USABLE = rf"(trim(regexp_replace({{0}}, '\s+', ' ', 'g')) <> '' AND len(string_split(trim(regexp_replace({{0}}, '\s+', ' ', 'g')), ' ')) <= 12 AND {_BARE} NOT IN ({_NONE}))"


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each key."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return records.last_wins(events, ["user_id", "event_type"], "event_id")


@query("SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn AND d.role = 'user')")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned calls that no record covers."""
    planned = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return records.unfinished(planned, planned.where("role = 'user'"), ["conv_id", "turn"])


@query("""
WITH b AS (SELECT event_type, event_id, user_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) AS n FROM events)
SELECT format('{}:{:06d}', event_type, (n // 32)::BIGINT) AS batch_id, count(*) AS n_calls, sha256(string_agg(user_id || chr(9) || event_id || chr(10), '' ORDER BY n)) AS members_sha256 FROM b GROUP BY 1""")
def canonical_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed batches and the hashes of their members."""
    return records.batch_certificates(records.batches(read(spark, sf_dir, "events"), "event_type", ["event_id"]), "user_id", "event_id")


@query("""
WITH b AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 32 AS n FROM events),
s AS (SELECT event_type || ':' || lpad(n::VARCHAR, 6, '0') AS batch_id, n::BIGINT AS batch_no, max(value) * count(*) AS padded FROM b GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY padded DESC, batch_id) AS start_order FROM s""")
def largest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which batches would start."""
    return records.largest_first(records.batches(read(spark, sf_dir, "events"), "event_type", ["event_id"]), "value")


@query("""
WITH c AS (SELECT conv_id, turn, role, min(text) AS text FROM conversations WHERE turn <> 3 OR conv_id % 5 <> 0 GROUP BY ALL),
u AS (SELECT conv_id, turn, min(role) AS role FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS want FROM u)
SELECT conv_id, turn, role FROM r WHERE want = turn""")
def contiguous_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns up to the first gap; some conversations get a gap at turn 3."""
    c = read(spark, sf_dir, "conversations").where("turn <> 3 or conv_id % 5 <> 0").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return records.contiguous(c, ["conv_id"], "turn").select("conv_id", "turn", "role")


@query("""
WITH u AS (SELECT conv_id, turn, min(role) AS role, min(length(text)) AS chars, CASE WHEN min(length(text)) % 7 = 0 THEN 'no' ELSE 'yes' END AS success FROM conversations GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS want FROM u),
k AS (SELECT *, coalesce(max((success = 'no')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM r WHERE want = turn)
SELECT conv_id, string_agg(turn || ':' || role || ':' || success, ' ' ORDER BY turn) AS history, max(turn) + 1 AS executed,
  CASE WHEN arg_max(success, turn) = 'no' THEN 'semantic_inability' ELSE 'plan_complete' END AS stop_reason FROM k WHERE failed = 0 GROUP BY conv_id""")
def history_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a conversation by its turns, and why it stopped."""
    chars = F.min(F.length("text"))
    c = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.when(chars % 7 == 0, "no").otherwise("yes").alias("success"))
    h = records.history(c, "conv_id", "turn", F.col("success"))
    line = F.transform("steps", lambda s: F.concat_ws(":", s["turn"].cast("string"), s["role"], s["success"]))
    last = F.element_at("steps", -1)
    return h.select("conv_id", F.array_join(line, " ").alias("history"), (last["turn"] + 1).alias("executed"), F.when(last["success"] == "no", "semantic_inability").otherwise("plan_complete").alias("stop_reason"))


_SHORT = "array_to_string(string_split(text, ' ')[1:CASE WHEN turn % 2 = 0 THEN 6 ELSE 20 END], ' ')"


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with an answer: the first words of the text, too many in odd turns."""
    n = F.when(F.col("turn") % 2 == 0, 6).otherwise(20)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_join(F.slice(F.split("text", " "), F.lit(1), n), " ").alias("answer"))


@query(rf"""
WITH a AS (SELECT conv_id, turn, {_SHORT} AS answer FROM conversations WHERE role = 'assistant' OR turn = 0),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, answer DESC) AS rn FROM a WHERE {_USABLE.format("answer")})
SELECT conv_id, trim(regexp_replace(answer, '\s+', ' ', 'g')) AS answer, turn AS step FROM u WHERE rn = 1""")
def last_usable_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer that can be used."""
    turns = _short(spark, sf_dir).where("role = 'assistant' or turn = 0").groupBy("conv_id", "turn").agg(F.max("answer").alias("answer"))
    return records.last_usable(turns, "conv_id", "turn", "answer")


@query(rf"""
WITH a AS (SELECT conv_id, turn, min({_SHORT}) AS answer FROM conversations GROUP BY ALL),
q AS (SELECT DISTINCT conv_id FROM a),
s AS (SELECT conv_id, nullif(answer, '') AS p FROM a WHERE turn = 0 AND conv_id % 3 = 0),
m AS (SELECT conv_id, answer AS p FROM a WHERE turn = 1 AND conv_id % 3 = 1),
f AS (SELECT conv_id, arg_max(answer, turn) AS f FROM a WHERE {_USABLE.format("answer")} GROUP BY conv_id),
j AS (SELECT q.conv_id, s.conv_id IS NOT NULL AS solo, s.p AS sp, m.p AS mp, f FROM q LEFT JOIN s USING (conv_id) LEFT JOIN m USING (conv_id) LEFT JOIN f USING (conv_id)),
k AS (SELECT *, CASE WHEN solo AND trim(coalesce(sp, '')) <> '' THEN 'solo_parsed' WHEN solo THEN 'none' WHEN mp IS NOT NULL AND {_USABLE.format("mp")} THEN 'summary_parsed' WHEN f IS NOT NULL THEN 'qa_fallback' ELSE 'none' END AS source FROM j)
SELECT conv_id, trim(regexp_replace(CASE source WHEN 'solo_parsed' THEN sp WHEN 'summary_parsed' THEN mp WHEN 'qa_fallback' THEN f ELSE '' END, '\s+', ' ', 'g')) AS answer, source FROM k""")
def final_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer for each conversation, from the first source that has one."""
    a = _short(spark, sf_dir).groupBy("conv_id", "turn").agg(F.min("answer").alias("answer"))
    as_record = lambda df: df.select("conv_id", F.nullif("answer", F.lit("")).alias("parsed"), F.lit(None).cast("string").alias("salvaged"))
    solo, summary = as_record(a.where("turn = 0 and conv_id % 3 = 0")), as_record(a.where("turn = 1 and conv_id % 3 = 1"))
    return records.final_answers(a.select("conv_id").distinct(), solo, summary, records.last_usable(a, "conv_id", "turn", "answer"), "conv_id")


@query(rf"""
WITH t AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL),
a AS (SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:2], ' ') AS answer FROM t),
e AS (SELECT a.conv_id, a.turn, bool_or({_NORM.format("answer")} <> '' AND contains(' ' || {_NORM.format("t.text")} || ' ', ' ' || {_NORM.format("answer")} || ' ')) AS g FROM a LEFT JOIN t ON t.conv_id = a.conv_id AND t.turn < a.turn GROUP BY ALL)
SELECT conv_id, turn, coalesce(g, false) AS grounded FROM e""")
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn's first words stand in the turns before it."""
    t = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    t = t.withColumn("answer", F.array_join(F.slice(F.split("text", " "), 1, 2), " "))
    return records.grounded_before(t, "conv_id", "turn", "text", "answer")


@query(
    corpus_queries._BM25
    + r""", s AS (SELECT item_id, rank, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda x: trim(x)), lambda x: x <> '')) AS span FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5)
SELECT item_id, span, min(rank)::INTEGER AS rank FROM s GROUP BY ALL"""
)
def evidence_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the best documents, each once, where it comes first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    s = corpus_queries._ranked(spark, sf_dir, 5).join(docs, "doc_id").select("item_id", "rank", F.posexplode(text.sentences(F.col("text"))).alias("pos", "span"))
    return records.first_seen(s, ["item_id"], "span", ["rank", "pos"]).select("item_id", "span", "rank")


@query("""
WITH e AS (SELECT p_brand AS run, p_type AS fp, max(p_size) AS s FROM part WHERE p_size > 0 GROUP BY ALL)
SELECT run, sum(s)::BIGINT AS total, max(s) AS peak, count(*) AS n_configs FROM e GROUP BY run""")
def distinct_config_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory of a run's different configurations."""
    return records.distinct_memory(read(spark, sf_dir, "part").withColumnRenamed("p_brand", "run"), "run", "p_type", "p_size")


@query("SELECT p_brand AS run, p_type AS role, count(DISTINCT p_size) AS n FROM part GROUP BY ALL HAVING count(DISTINCT p_size) > 1")
def isolated_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles with two configurations."""
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), F.col("p_type").alias("role"), "p_size")
    return records.two_configurations(part, "run", "role", "p_size")


@query("""SELECT event_type, k AS key, sum(n)::BIGINT AS n FROM (SELECT event_type, unnest([('k' || user_id % 5), 'all']) AS k, unnest([1, 2]) AS n FROM events) GROUP BY ALL""")
def merged_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of counts, merged."""
    m = F.create_map(F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string")), F.lit(1), F.lit("all"), F.lit(2))
    return records.merged_counts(read(spark, sf_dir, "events").select("event_type", m.alias("m")), ["event_type"], "m")


@query("SELECT event_id FROM events WHERE event_id % 97 = 0")
def regenerated_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that differ from what planning them again gives."""
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    again = events.withColumn("value", F.when(F.col("event_id") % 97 == 0, F.coalesce("value", F.lit(0.0)) + 1).otherwise(F.col("value")))
    return records.changed(events, again, ["event_id"], ["event_type", "value"]).select("event_id")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs as models might give them, made from event properties in six ways."""
    e = read(spark, sf_dir, "events")
    way = F.col("event_id") % 6
    good = F.concat(F.lit('{"analysis": "a", "answer": '), F.col("value").cast("string"), F.lit(', "success": "Yes", "rating": 3}'))
    raw = F.when(way == 0, good).when(way == 1, F.concat(F.lit("Sure:\n```json\n"), good, F.lit("\n```"))).when(way == 2, F.col("props")).when(way == 3, F.lit("I am sorry, I cannot.")).when(way == 4, F.substring(good, 1, 20)).otherwise("  ")
    return e.select("event_id", F.lit("qa").alias("role"), raw.alias("raw"), (F.col("event_id") % 12 == 4).alias("hit_cap"))


@query("""
SELECT CASE WHEN value IS NULL AND event_id % 6 IN (0, 1, 4) OR props IS NULL AND event_id % 6 = 2 THEN 'empty_output' ELSE CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'schema_mismatch' WHEN 3 THEN 'refusal_or_offtopic' WHEN 5 THEN 'empty_output' ELSE CASE WHEN event_id % 12 = 4 THEN 'truncated' ELSE 'malformed_json' END END END AS status,
  event_id % 6 = 0 AND value IS NOT NULL AS strict_format_ok, event_id % 6 = 0 AND value IS NOT NULL AS protocol_ok, count(*) AS n FROM events GROUP BY ALL""")
def parse_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of outputs."""
    rows = _raw(spark, sf_dir).withColumn("p", outputs.parsed("role", "raw", "hit_cap"))
    return rows.groupBy("p.status", "p.strict_format_ok", "p.protocol_ok").agg(F.count("*").alias("n"))


@query()
def salvaged_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be used of outputs that were refused."""
    rows = _raw(spark, sf_dir).withColumn("raw", F.regexp_replace("raw", '"rating": 3', '"rating": 30')).withColumn("p", outputs.parsed("role", "raw", "hit_cap"))
    return rows.select("event_id", "p.status", "p.salvaged")


@query("SELECT event_id, 0::INTEGER AS pos, props AS blob FROM events WHERE props LIKE '{%}'")
def json_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of JSON, by a table function."""
    spark.udtf.register("json_blobs", outputs.JsonBlobs)
    noisy = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("so: "), F.col("props"), F.lit(" {open [")).alias("raw"))
    return spark.sql("SELECT event_id, b.pos, b.blob FROM {noisy}, LATERAL json_blobs(raw) b", noisy=noisy)


_SPANS = (
    corpus_queries._INDEX
    + r"""
, x0 AS (SELECT doc_id, sent_id AS span_no, CASE sent_id % 3 WHEN 0 THEN text WHEN 1 THEN left(text, 30) ELSE text || ' and more' END AS span FROM idx),
l AS (SELECT doc_id, span_no, lower(trim(regexp_replace(span, '\s+', ' ', 'g'))) AS s FROM x0),
r AS (SELECT doc_id, sent_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM idx)
"""
)


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spans made from every sentence of every document: whole, cut, extended; and all sentences."""
    index = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("sent_id", "text"))
    way = F.col("sent_id") % 3
    span = F.when(way == 0, F.col("text")).when(way == 1, F.substring("text", 1, 30)).otherwise(F.concat("text", F.lit(" and more")))
    return index.select("doc_id", F.col("sent_id").cast("long").alias("span_no"), span.alias("span")), index.withColumn("sent_id", F.col("sent_id").cast("long"))


@query(_SPANS + "SELECT l.doc_id, span_no, count(*) FILTER (s = t) AS n_exact, count(*) FILTER (contains(s, t)) AS n_within, count(*) FILTER (contains(t, s)) AS n_around FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND t <> '' GROUP BY ALL")
def normalize_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences a span is, holds or is part of."""
    return spans.located(*_spans(spark, sf_dir), "doc_id")


@query()
def normalize_spans_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all sentences mapped to sentences, with reasons and modes."""
    made, index = _spans(spark, sf_dir)
    a = made.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("span_no", "span"))), lambda x: x["span"]).alias("spans"))
    b = index.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sent_id", "text"))), lambda x: x["text"]).alias("sentences"))
    m = a.join(b, "doc_id").select("doc_id", spans.mapped("spans", "sentences").alias("m"))
    return m.select("doc_id", F.array_join("m.sentences", "\n").alias("accepted"), "m.n_accepted", "m.n_rejected", F.to_json("m.reasons").alias("reasons"), F.to_json("m.modes").alias("modes"))


@query(_SPANS + "SELECT l.doc_id, span_no, sent_id FROM l JOIN r ON r.doc_id = l.doc_id WHERE length(s) >= 25 AND (contains(t, s) OR (contains(s, t) AND length(t) >= 25))")
def attribute_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that spans were copied from."""
    return spans.attributed(*_spans(spark, sf_dir), "doc_id")


@query(
    _SPANS
    + """, h AS (SELECT l.doc_id, span_no, count(*) AS n FROM l JOIN r ON r.doc_id = l.doc_id WHERE length(s) >= 25 AND (contains(t, s) OR (contains(s, t) AND length(t) >= 25)) GROUP BY ALL)
SELECT l.doc_id, count(*) AS n_spans, count(*) FILTER (length(s) < 25) AS too_short, count(*) FILTER (length(s) >= 25 AND n IS NULL) AS unmatched, count(*) FILTER (n > 1) AS ambiguous, count(*) FILTER (n = 1) AS uniquely
FROM l LEFT JOIN h ON h.doc_id = l.doc_id AND h.span_no = l.span_no GROUP BY l.doc_id"""
)
def attribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far attribution can be trusted."""
    return spans.attribution_stats(*_spans(spark, sf_dir), "doc_id")


@query(
    _SPANS
    + """, p AS (SELECT DISTINCT l.doc_id, sent_id FROM l JOIN r ON r.doc_id = l.doc_id WHERE length(s) >= 25 AND (contains(t, s) OR (contains(s, t) AND length(t) >= 25))),
g AS (SELECT doc_id, sent_id FROM r WHERE sent_id < 3),
d AS (SELECT DISTINCT doc_id FROM r),
c AS (SELECT d.doc_id, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id) AS np, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id) AS ng, (SELECT count(*) FROM p JOIN g USING (doc_id, sent_id) WHERE p.doc_id = d.doc_id) AS tp FROM d)
SELECT doc_id, CASE WHEN np > 0 THEN round(tp / np, 9) ELSE 0.0 END::DOUBLE AS precision, round(tp / ng, 9) AS recall, CASE WHEN tp > 0 THEN round(2.0 * tp / (np + ng), 9) ELSE 0.0 END::DOUBLE AS f1, (np = tp AND ng = tp)::INTEGER::DOUBLE AS em FROM c"""
)
def evidence_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of attributed sentences against gold ones, the first three of a document."""
    made, index = _spans(spark, sf_dir)
    pred = spans.attributed(made, index, "doc_id").groupBy("doc_id").agg(F.collect_set("sent_id").alias("p"))
    gold = index.groupBy("doc_id").agg(F.collect_set(F.when(F.col("sent_id") < 3, F.col("sent_id"))).alias("g"))
    both = gold.join(pred, "doc_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<bigint>")))
    return both.select("doc_id", *[F.round(c, 9).alias(n) for n, c in spans.set_scores(F.col("p"), F.col("g")).items()])


@query(_SPANS + "SELECT l.doc_id, round(avg(contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), s)::INTEGER), 9) AS rate FROM l JOIN documents USING (doc_id) GROUP BY ALL")
def verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a document's spans that stand in its text."""
    made, _ = _spans(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = made.groupBy("doc_id").agg(F.collect_list("span").alias("spans")).join(docs, "doc_id")
    return rows.select("doc_id", F.round(text.verbatim_rate(F.col("spans"), F.col("text")), 9).alias("rate"))


@query()
def canonical_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of properties and its hash."""
    c = text.canonical("props")
    return read(spark, sf_dir, "events").select("event_id", c.alias("canonical")).withColumn("sha256", F.sha2("canonical", 256))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '-instruct$', ''), '[^a-z0-9.]+', '-', 'g') AS slug FROM (SELECT p_partkey, p_type FROM part)""")
def model_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as slugs."""
    return read(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat(F.lit("org/"), F.col("p_type"))).alias("slug"))


def _flow(spark: SparkSession, sf_dir: str) -> dataflow.Run:
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return dataflow.Run(items, read(spark, sf_dir, "documents").select("doc_id", "text"), dataflow.Stub())


@query()
def dataflow_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan, steps and summary of every item, by the stub generator."""
    return _flow(spark, sf_dir).answers()


@query()
def dataflow_solo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the one-call control."""
    run = _flow(spark, sf_dir)
    return dataflow.solo(run.questions, run.passages, run.generator).all_calls()


_RETRIEVED = """
WITH c AS (SELECT l_orderkey AS question_id, l_linenumber AS step, CASE WHEN l_linenumber % 2 = 1 THEN 'a' ELSE 't' END AS name, l_returnflag <> 'N' AS attempted, CASE WHEN l_returnflag = 'R' AND l_discount < 0.03 THEN NULL ELSE l_partkey % 20 END AS title FROM lineitem),
g AS (SELECT DISTINCT o_orderkey AS question_id, unnest([o_custkey % 20, o_custkey % 7]) AS title FROM orders),
gn AS (SELECT question_id, count(*) AS n FROM g GROUP BY ALL),
found AS (SELECT question_id, count(*) AS all_n, count(*) FILTER (a) AS a_n, count(*) FILTER (t) AS t_n, count(*) FILTER (t AND NOT a) AS inc
  FROM (SELECT g.question_id, g.title, bool_or(c.name = 'a') AS a, bool_or(c.name = 't') AS t FROM g JOIN c ON c.question_id = g.question_id AND c.title = g.title AND c.attempted GROUP BY ALL) GROUP BY question_id),
q AS (SELECT question_id, count(DISTINCT step) FILTER (attempted) AS steps, count(*) FILTER (attempted) AS queries, count(*) FILTER (attempted AND title IS NULL) AS zero, count(*) FILTER (attempted AND name = 'a') AS anchors, count(*) FILTER (attempted AND name = 't') AS tasks FROM c GROUP BY question_id)
"""


@query(
    _RETRIEVED
    + """SELECT gn.question_id, gn.n::INTEGER AS n_gold, round(coalesce(all_n, 0) / gn.n, 9) AS recall, coalesce(all_n, 0) = gn.n AS all_gold, coalesce(steps, 0) AS step_count, coalesce(queries, 0) AS query_count, coalesce(zero, 0) AS zero_result_count,
  CASE WHEN anchors > 0 THEN round(coalesce(a_n, 0) / gn.n, 9) END AS anchor_recall, CASE WHEN tasks > 0 THEN round(coalesce(t_n, 0) / gn.n, 9) END AS task_recall, coalesce(tasks, 0) AS task_query_count, coalesce(tasks, 0) > 0 AS followup_fired,
  CASE WHEN steps > 0 THEN round(tasks / steps, 9) ELSE 0.0 END::DOUBLE AS firing_rate, round(coalesce(inc, 0) / gn.n, 9) AS incremental_recall
FROM gn LEFT JOIN found USING (question_id) LEFT JOIN q USING (question_id)"""
)
def answer_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval of each question; orders are questions, their lineitems queries in turn of the question and of tasks."""
    items, part = read(spark, sf_dir, "lineitem"), F.col("l_partkey") % 20
    attempted = F.col("l_returnflag") != "N"
    titles = F.when(attempted & ~((F.col("l_returnflag") == "R") & (F.col("l_discount") < 0.03)), F.array(part)).otherwise(F.array().cast("array<bigint>"))
    name = F.when(F.col("l_linenumber") % 2 == 1, answers.ANCHOR).otherwise(answers.TASK)
    asked = items.select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("step"), name.alias("name"), attempted.alias("attempted"), titles.alias("titles"))
    gold = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.array(F.col("o_custkey") % 20, F.col("o_custkey") % 7).alias("gold_titles"))
    made = answers.retrieval_metrics(asked, gold, "question_id").withColumn("n_gold", F.size("gold_titles")).drop("gold_titles", "titles", "retrieved_gold", "incremental_gold")
    return made.withColumns({c: F.round(c, 9) for c in ("recall", "anchor_recall", "task_recall", "firing_rate", "incremental_recall")})


@query()
def dataflow_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the dataflow scored against each item's first words, the documents that hold the item, and its sentences."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("gold_answer"), text.sentences(F.col("text")).alias("gold_sentences"))
    held = corpus_queries.gold_documents(spark, sf_dir).groupBy(F.col("item_id").alias("question_id")).agg(F.sort_array(F.collect_set("doc_id")).alias("gold_titles"))
    gold = items.join(held, "question_id", "left").withColumn("gold_titles", F.coalesce("gold_titles", F.array().cast("array<bigint>")))
    return _flow(spark, sf_dir).scored(gold)
