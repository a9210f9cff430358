"""Queries that compare runs: languages, flags and priorities stand for runs, sources for strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analytics, stats
from .registry import query, read

_LABELLED = "WITH s AS (SELECT d.doc_id, d.lang, d.source, l.quality::DOUBLE AS em, l.toxic::DOUBLE AS f1 FROM documents d JOIN labels l USING (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("em"), F.col("toxic").cast("double").alias("f1"))
    return docs.join(labels, "doc_id")


@query(
    _LABELLED
    + "SELECT lang, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n, round(avg(em), 9) AS mean_em, round(avg(f1), 9) AS mean_f1 FROM s GROUP BY GROUPING SETS ((lang), (lang, source))"
)
def run_means_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of every run, over all and by stratum."""
    out = analytics.strata(_labelled(spark, sf_dir), "lang", "source", ["em", "f1"])
    return out.select("lang", "source", "n", F.round("mean_em", 9).alias("mean_em"), F.round("mean_f1", 9).alias("mean_f1"))


@query("""
WITH l AS (SELECT o_orderpriority AS run, o_orderstatus AS stratum, unnest(['price', 'rush', 'open_price']) AS metric,
  unnest([o_totalprice, (o_orderpriority LIKE '1%')::INTEGER::DOUBLE, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END]) AS value FROM orders)
SELECT metric, run, CASE WHEN grouping(stratum) = 1 THEN 'all' ELSE stratum END AS stratum, count(value) AS n, round(avg(value), 4) AS mean
FROM l GROUP BY GROUPING SETS ((metric, run), (metric, run, stratum))""")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many metrics by run and stratum; nulls don't count."""
    wide = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("stratum"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").startswith("1").cast("double").alias("rush"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("open_price"))
    long = wide.unpivot(["run", "stratum"], ["price", "rush", "open_price"], "metric", "value")
    out = long.groupingSets([["metric", "run"], ["metric", "run", "stratum"]], "metric", "run", "stratum").agg(F.grouping("stratum").alias("g"), F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    return out.select("metric", "run", F.when(F.col("g") == 1, "all").otherwise(F.col("stratum")).alias("stratum"), "n", "mean")


@query("""SELECT user_id % 10 AS stage, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages by status."""
    rows = read(spark, sf_dir, "events").withColumn("stage", F.col("user_id") % 10)
    out = rows.groupBy("stage").pivot("event_type", ["click", "view", "purchase"]).agg(F.count("event_id"))
    return out.select("stage", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "view", "purchase")])


_ARMS = """WITH a AS (SELECT l_orderkey, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS l_orderkey, o_totalprice / 7 AS v FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("v"))
    b = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 7).alias("v"))
    return a, b.join(a.select("l_orderkey"), "l_orderkey", "left_semi")


@query(_ARMS + " SELECT l_orderkey, round((a.v - b.v) * 100, 2) AS difference FROM a JOIN b USING (l_orderkey)")
def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences by unit; both arms have the same units."""
    return analytics.paired(*_arms(spark, sf_dir), "l_orderkey", "v").withColumn("difference", F.round("difference", 2))


@query("SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, CASE WHEN l_orderkey IS NULL THEN 'left' ELSE 'right' END AS side FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR l_orderkey IS NULL")
def id_set_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of one side only."""
    a = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"))
    return stats.same_units(a, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey")), "orderkey")


@query("""
WITH e AS (SELECT c_custkey, c_mktsegment FROM customer), k AS (SELECT DISTINCT o_orderstatus AS status FROM orders),
f AS (SELECT o_custkey, o_orderstatus, count(*) AS n, sum(o_orderkey) AS total FROM orders GROUP BY ALL)
SELECT c_custkey, status, coalesce(n, 0) AS n, coalesce(total, 0)::BIGINT AS total FROM e CROSS JOIN k LEFT JOIN f ON o_custkey = c_custkey AND o_orderstatus = status""")
def call_counts_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of every unit and stage, 0 where there are none."""
    facts = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("total"))
    return analytics.zero_filled(read(spark, sf_dir, "customer"), facts, facts, "c_custkey", "status", ["total"])


@query("SELECT event_type, count(DISTINCT user_id) AS clusters, round(sum((value > 50)::INTEGER) / count(*), 9) AS rate FROM events GROUP BY event_type")
def clustered_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate whose units come in clusters."""
    per = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.sum((F.col("value") > 50).cast("int")).alias("num"), F.count("*").alias("den"))
    return per.groupBy("event_type").agg(F.count("*").alias("clusters"), F.round(F.sum("num") / F.sum("den"), 9).alias("rate"))


@query("""
WITH q AS (SELECT event_type, user_id, bool_or(value > 90) AS failed, count(*) AS n FROM events GROUP BY ALL)
SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS stage, count(*) AS n_questions, round(avg(failed::INTEGER), 9) AS any_failure, round(sum(n) / count(*), 9) AS calls FROM q GROUP BY GROUPING SETS ((event_type), ())""")
def any_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of questions with any failure, by stage and over all."""
    q = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.bool_or(F.col("value") > 90).alias("failed"), F.count("*").alias("n"))
    out = q.groupingSets([["event_type"], []], "event_type").agg(F.grouping("event_type").alias("g"), F.count("*").alias("n_questions"), F.round(F.avg(F.col("failed").cast("int")), 9).alias("any_failure"), F.round(F.sum("n") / F.count("*"), 9).alias("calls"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("event_type")).alias("stage"), "n_questions", "any_failure", "calls")


@query("""
WITH k AS (SELECT l_returnflag, l_suppkey, l_linenumber, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
a AS (SELECT * FROM k WHERE l_returnflag = 'A'), r AS (SELECT * FROM k WHERE l_returnflag = 'R')
SELECT l_linenumber, count(*) FILTER (a.q IS NOT NULL AND r.q IS NOT NULL) AS n_shared, count(*) FILTER (a.q <> r.q) AS n_changed, count(*) FILTER (r.q IS NULL) AS n_left, count(*) FILTER (a.q IS NULL) AS n_right
FROM a FULL JOIN r USING (l_suppkey, l_linenumber) GROUP BY l_linenumber""")
def churn_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of two runs over the keys they share, and those of one only."""
    k = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    arm = lambda flag: k.where(F.col("l_returnflag") == flag).drop("l_returnflag")
    return analytics.churn(arm("A"), arm("R"), ["l_suppkey", "l_linenumber"], F.col("q") != F.col("b_q"), ["l_linenumber"])


@query("""SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice > a.p_retailprice))""")
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no other beats in size and price."""
    return analytics.pareto(read(spark, sf_dir, "part"), "p_partkey", "p_size", "p_retailprice")


@query("""
WITH b AS (SELECT DISTINCT o_custkey % 60 AS budget FROM orders)
SELECT budget, arg_max(p_partkey, (p_retailprice, -p_size, p_partkey)) AS best_name, max(p_retailprice) AS best_gain FROM b LEFT JOIN part ON p_size <= budget GROUP BY budget""")
def best_uniform_leq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best part within each budget."""
    budgets = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).alias("budget")).distinct()
    return analytics.best_within(budgets, "budget", read(spark, sf_dir, "part"), "p_partkey", "p_size", "p_retailprice")


_CONFIGS = "SELECT r_name AS configuration, 100.0 - 15 * r_regionkey AS footprint, -0.3 * r_regionkey AS effect FROM region"


@query(f"""
WITH c AS ({_CONFIGS}), d AS (SELECT configuration, footprint, effect, i, effect + ((ascii(configuration) + 7 * i) % 11 - 5) / 20.0 AS v FROM c CROSS JOIN range(40) t(i)),
x AS (SELECT a.configuration || ',' || b.configuration || ',' || e.configuration AS allocation, list_distinct([a.configuration, b.configuration, e.configuration]) AS used, round(a.effect + b.effect + e.effect, 9)::DOUBLE AS effect, a.configuration AS ca, b.configuration AS cb, e.configuration AS ce FROM c a CROSS JOIN c b CROSS JOIN c e),
s AS (SELECT allocation, da.v + db.v + de.v AS v FROM x JOIN d da ON da.configuration = ca JOIN d db ON db.configuration = cb AND db.i = da.i JOIN d de ON de.configuration = ce AND de.i = da.i),
l AS (SELECT allocation, round((list(v ORDER BY v))[2], 9)::DOUBLE AS lower FROM s GROUP BY allocation)
SELECT allocation, effect, lower, len(used)::INTEGER AS n_configs, (SELECT sum(footprint) FROM c WHERE list_contains(used, configuration))::DOUBLE AS footprint FROM x JOIN l USING (allocation) WHERE lower >= -1.5
ORDER BY footprint, effect DESC, n_configs, allocation LIMIT 1""")
def allocation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest assignment of configurations to three roles that isn't clearly worse."""
    c = read(spark, sf_dir, "region").select(F.col("r_name").alias("configuration"), (100.0 - 15 * F.col("r_regionkey")).alias("footprint"), (-0.3 * F.col("r_regionkey")).alias("effect"))
    noise = lambda i: F.col("effect") + ((F.ascii("configuration") + 7 * i) % 11 - 5) / 20.0
    effects = c.select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("role"), "configuration", "effect", F.transform(F.sequence(F.lit(0), F.lit(39)), noise).alias("draws"))
    return analytics.allocation(effects, c, ["a", "b", "c"], 1.5)


@query("""
WITH b AS (SELECT event_type AS stage, user_id % 2 AS run, sum(value) AS wall, count(*) AS calls FROM events GROUP BY ALL)
SELECT a.stage, round(a.wall / a.calls, 6) AS per_call, round(b.wall / b.calls, 6) AS base_per_call, round((a.wall / a.calls) / (b.wall / b.calls), 6) AS ratio FROM b a JOIN b ON a.stage = b.stage AND a.run = 1 AND b.run = 0""")
def latency_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds a call by stage, against the baseline run."""
    b = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage"), (F.col("user_id") % 2).alias("run")).agg((F.sum("value") / F.count("*")).alias("s"))
    per = lambda run, name: b.where(F.col("run") == run).select("stage", F.col("s").alias(name))
    both = per(1, "a").join(per(0, "b"), "stage")
    return both.select("stage", F.round("a", 6).alias("per_call"), F.round("b", 6).alias("base_per_call"), F.round(F.col("a") / F.col("b"), 6).alias("ratio"))


@query(
    _LABELLED
    + """, m AS (SELECT lang, count(*) AS n, avg(em) AS em, avg(f1) AS f1, count(DISTINCT source) AS strata FROM s GROUP BY lang)
SELECT lang, n, round(em, 9) AS em, round(f1, 9) AS f1, strata, CASE WHEN em >= 0.85 AND strata >= 15 THEN 'GO' ELSE 'STOP' END AS decision FROM m"""
)
def pilot_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a pilot against thresholds."""
    m = _labelled(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.avg("em").alias("em"), F.avg("f1").alias("f1"), F.countDistinct("source").alias("strata"))
    return analytics.gate(m, {"em": 0.85, "strata": 15}).select("lang", "n", F.round("em", 9).alias("em"), F.round("f1", 9).alias("f1"), "strata", "decision")


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) % 6)::INTEGER AS worker, (row_number() OVER (ORDER BY p_partkey) - 1) // 6 AS turn FROM part")
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs dealt to workers in turn."""
    return analytics.shard_plan(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 6)


@query("SELECT c_custkey FROM customer ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample by hash, for tables that no driver holds. The limit is the operator's purpose."""
    return analytics.hash_sampled(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100, 7)


@query("""
SELECT *, violations = 0 AS ok FROM (
SELECT 'orders_have_customers' AS name, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS violations
UNION ALL SELECT 'orders_have_lines', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS v
UNION ALL SELECT 'labels_once', (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)) AS v
UNION ALL SELECT 'chars_match', (SELECT count(*) FROM documents WHERE n_chars IS DISTINCT FROM length(text)) AS v
UNION ALL SELECT 'turns_contiguous', (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) + 1 <> count(DISTINCT turn))) AS v)""")
def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named invariants and how many rows break them."""
    t = {n: read(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "labels", "documents", "conversations")}
    return analytics.expectations({
        "orders_have_customers": t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "orders_have_lines": t["orders"].join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"),
        "labels_once": t["labels"].groupBy("doc_id").count().where("count > 1"),
        "chars_match": t["documents"].where(~F.col("n_chars").eqNullSafe(F.length("text"))),
        "turns_contiguous": t["conversations"].groupBy("conv_id").agg(F.max("turn").alias("m"), F.countDistinct("turn").alias("n")).where("m + 1 <> n"),
    })


@query("""
WITH e AS (SELECT DISTINCT n_regionkey AS k FROM nation UNION ALL SELECT 99), p AS (SELECT r_regionkey AS k FROM region UNION ALL SELECT 77)
SELECT k, 'missing' AS side FROM (SELECT k FROM e EXCEPT ALL SELECT k FROM p) UNION ALL SELECT k, 'unexpected' FROM (SELECT k FROM p EXCEPT ALL SELECT k FROM e)""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against present."""
    extra = lambda k: spark.sql(f"SELECT {k} AS k")
    e = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")).distinct().unionAll(extra(99))
    return analytics.set_difference(e, read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")).unionAll(extra(77)))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 3 = 1 THEN value * 2 END, event_id::DOUBLE) AS size FROM events")
def synonym_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first synonym that has a value."""
    third = F.col("event_id") % 3
    wide = read(spark, sf_dir, "events").select("event_id", F.when(third == 0, F.col("value")).alias("memory_mib"), F.when(third == 1, F.col("value") * 2).alias("memory_mb"), F.col("event_id").cast("double").alias("weight_mib"))
    return analytics.coalesced(wide, {"size": ["memory_mib", "memory_mb", "absent", "weight_mib"]}).select("event_id", "size")


@query("""
WITH m AS (SELECT p_brand, avg(p_size) AS memory, avg(p_retailprice) AS score FROM part GROUP BY p_brand),
x AS (SELECT a.p_brand AS brand, b.p_brand AS near, abs(a.memory - b.memory) AS gap, a.score - b.score AS difference, row_number() OVER (PARTITION BY a.p_brand ORDER BY abs(a.memory - b.memory), b.p_brand) AS rn FROM m a JOIN m b ON a.p_brand <> b.p_brand)
SELECT brand, near, round(gap, 6) AS gap, round(difference, 4) AS difference FROM x WHERE rn = 1""")
def near_memory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each configuration the one nearest in memory. A row for each configuration, so the pairs are few."""
    m = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_size").alias("memory"), F.avg("p_retailprice").alias("score"))
    b = m.select(F.col("p_brand").alias("near"), F.col("memory").alias("m2"), F.col("score").alias("s2"))
    pairs = m.join(F.broadcast(b), F.col("p_brand") != F.col("near")).withColumn("gap", F.abs(F.col("memory") - F.col("m2")))
    best = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("p_brand").orderBy("gap", "near"))).where("rn = 1")
    return best.select(F.col("p_brand").alias("brand"), "near", F.round("gap", 6).alias("gap"), F.round(F.col("score") - F.col("s2"), 4).alias("difference"))


@query("""
WITH t AS (SELECT conv_id, turn, role, length(text) >= 200 AS cut, length(text) AS n FROM conversations),
g AS (SELECT role, turn % 2 AS half, count(*) AS n_calls, round(avg(cut::INTEGER), 9) AS cut_rate FROM t GROUP BY ALL),
o AS (SELECT role, turn % 2 AS half, n, row_number() OVER (PARTITION BY role, turn % 2 ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY role, turn % 2) AS m FROM t)
SELECT role, half, n_calls, cut_rate, (SELECT max(o.n) FROM o WHERE o.role = g.role AND o.half = g.half AND i = m // 2) AS median, (SELECT max(o.n) FROM o WHERE o.role = g.role AND o.half = g.half AND i = floor(0.9::DOUBLE * m)) AS p90 FROM g""")
def cap_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a cap bites, and order statistics of lengths."""
    keys = ["role", "half"]
    t = read(spark, sf_dir, "conversations").select("role", (F.col("turn") % 2).alias("half"), F.length("text").cast("long").alias("size"))
    o = stats.numbered_within(t, keys, ["size"]).withColumnRenamed("n", "m")  # by ranges: there are few keys
    at = lambda place: F.max(F.when(F.col("i") == place, F.col("size")))
    return o.groupBy(*keys).agg(F.count("*").alias("n_calls"), F.round(F.avg((F.col("size") >= 200).cast("int")), 9).alias("cut_rate"), at(F.floor(F.col("m") / 2)).alias("median"), at(F.floor(F.lit(0.9) * F.col("m"))).alias("p90"))


@query("""
WITH q AS (SELECT conv_id, count(DISTINCT role) = 1 AS same, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT same, count(*) AS n_questions, round(avg(n), 9) AS mean_steps FROM q GROUP BY same""")
def query_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that ask the same at every step."""
    q = read(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.countDistinct("role") == 1).alias("same"), F.count("*").alias("n"))
    return q.groupBy("same").agg(F.count("*").alias("n_questions"), F.round(F.avg("n"), 9).alias("mean_steps"))
