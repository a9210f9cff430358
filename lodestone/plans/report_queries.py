"""Reports over runs, made of events, orders and lineitems: events are calls, users questions, event types stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, reports, stats
from .registry import SQL, query, read
from .stats_queries import HI, LO, drawn

_DRAWS = stats.REPLICATES
#: What an assignment may lose.
_MARGIN = 9.0


def _interval(strata: str, values: str, ratio: str, sums: str) -> str:
    """CTEs u, m, r, k from a table long (strata, values): hashed draws, their statistic and its bounds."""
    return drawn(strata, values, sums) + f""",
r AS (SELECT {strata}, d, {ratio} AS v, row_number() OVER (PARTITION BY {strata} ORDER BY {ratio}) - 1 AS k FROM m),
k AS (SELECT {strata}, max(v) FILTER (k = {LO}) AS lo, max(v) FILTER (k = {HI}) AS hi FROM r GROUP BY {strata})"""


_CALLS = """
WITH calls AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'small' END AS run, event_type AS stage, CASE WHEN event_type IN ('click', 'view') THEN 'reader' ELSE 'writer' END AS role, user_id AS question, value > 90 AS failed,
  event_id % 3 = 0 AS salvaged, CASE WHEN value > 90 THEN CASE WHEN event_id % 3 = 0 THEN 'salvaged' ELSE 'fallback' END WHEN event_type <> 'error' THEN 'parsed' END AS source, value <= 60 AS strict_ok, value <= 75 AS protocol_ok,
  CASE WHEN event_type = 'view' THEN least(value / 100, 1.0::DOUBLE) END AS copy_rate FROM events)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = read(spark, sf_dir, "events"), F.col("value")
    third, kind = F.col("event_id") % 3 == 0, F.col("event_type")
    source = F.when(v > 90, F.when(third, "salvaged").otherwise("fallback")).when(kind != "error", "parsed")
    return e.select(
        F.when(F.col("event_id") % 2 == 0, "base").otherwise("small").alias("run"), kind.alias("stage"), F.when(kind.isin("click", "view"), "reader").otherwise("writer").alias("role"), F.col("user_id").alias("question"),
        (v > 90).alias("failed"), third.alias("salvaged"), source.alias("source"), (v <= 60).alias("strict_ok"), (v <= 75).alias("protocol_ok"), F.when(kind == "view", F.least(v / 100, F.lit(1.0))).alias("copy_rate"),
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    _CALLS
    + """, l AS (SELECT *, 'stage' AS level, stage AS name FROM calls UNION ALL SELECT *, 'role', role FROM calls),
q AS (SELECT run, level, name, question, count(*) AS n, sum(failed::INTEGER) AS f, sum((failed AND salvaged)::INTEGER) AS s, count(source) AS c, sum((source = 'salvaged')::INTEGER) AS us, sum(strict_ok::INTEGER) AS st, sum(protocol_ok::INTEGER) AS pr, avg(copy_rate) AS cr, count(copy_rate) AS cn FROM l GROUP BY ALL),
long AS (SELECT run, level, name, question, x.metric AS metric, x.num AS num, x.den AS den FROM (SELECT *, unnest([{'metric': 'failure', 'num': f::DOUBLE, 'den': n::DOUBLE}, {'metric': 'any_failure', 'num': (f > 0)::INTEGER::DOUBLE, 'den': 1.0::DOUBLE}, {'metric': 'salvaged', 'num': s::DOUBLE, 'den': f::DOUBLE},
  {'metric': 'used_salvage', 'num': us::DOUBLE, 'den': c::DOUBLE}, {'metric': 'strict', 'num': st::DOUBLE, 'den': n::DOUBLE}, {'metric': 'protocol', 'num': pr::DOUBLE, 'den': n::DOUBLE}, {'metric': 'copy_rate', 'num': cr, 'den': (cn > 0)::INTEGER::DOUBLE}]) AS x FROM q) WHERE x.den > 0)"""
    + _interval("run, level, name, metric", "num, den", "num / den", "sum(num) AS num, sum(den) AS den")
    + """, w AS (SELECT run, level, name, metric, sum(num) / sum(den) AS estimate, count(*) AS n_units, sum(den)::BIGINT AS n FROM long GROUP BY ALL)
SELECT run, level, name, metric, round(estimate, 6) AS estimate, round(lo, 6) AS lo, round(hi, 6) AS hi, n_units, n FROM w JOIN k USING (run, level, name, metric)"""
)
def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure, salvage, strict, protocol and copy rates by run and stage, and by run and role, with intervals."""
    return _rounded(reports.failure_report(_calls(spark, sf_dir), "run", ["stage", "role"], "question", _DRAWS), "estimate", "lo", "hi")


_ANSWERED = """
WITH a AS (SELECT d.source AS run, d.lang AS stratum, d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)),
s AS (SELECT run, stratum, doc_id, quality, toxic FROM a UNION ALL SELECT run, 'all', doc_id, quality, toxic FROM a),
long AS (SELECT run, stratum, doc_id, x.metric AS metric, x.num AS num FROM (SELECT *, unnest([{'metric': 'quality', 'num': quality::DOUBLE}, {'metric': 'toxic', 'num': toxic::DOUBLE}]) AS x FROM s WHERE run IS NOT NULL AND stratum IS NOT NULL) WHERE x.num IS NOT NULL)"""


@query(
    _ANSWERED
    + _interval("run, stratum, metric", "num", "num / n", "sum(num) AS num")
    + """, w AS (SELECT run, stratum, metric, avg(num) AS estimate, count(*) AS n_units FROM long GROUP BY ALL), z AS (SELECT run, count(DISTINCT doc_id) < 40 AS appendix FROM a GROUP BY run)
SELECT run, stratum, metric, round(estimate, 6) AS estimate, round(lo, 6) AS lo, round(hi, 6) AS hi, n_units, appendix FROM w JOIN k USING (run, stratum, metric) JOIN z USING (run)"""
)
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means with intervals by run, over all and by stratum; runs of fewer than 40 units go to the appendix."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("run"), F.col("lang").alias("stratum"))
    answers = docs.join(read(spark, sf_dir, "labels"), "doc_id")
    return _rounded(reports.accuracy(answers, "run", "stratum", "doc_id", ["quality", "toxic"], 40, _DRAWS), "estimate", "lo", "hi")


_ARMS = """
WITH arms AS (SELECT c_custkey AS unit, s.arm AS arm, coalesce(sum((o_orderstatus = s.arm)::INTEGER), 0)::DOUBLE AS f1, coalesce(max((o_orderstatus = s.arm AND o_orderkey % 2 = 0)::INTEGER), 0)::DOUBLE AS em
  FROM customer CROSS JOIN (SELECT DISTINCT o_orderstatus AS arm FROM orders) s LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
long AS (SELECT arm, unit, x.metric AS metric, x.d AS difference FROM (SELECT a.arm, a.unit, unnest([{'metric': 'f1', 'd': a.f1 - b.f1}, {'metric': 'em', 'd': a.em - b.em}]) AS x FROM arms a JOIN arms b ON a.unit = b.unit AND b.arm = 'O' WHERE a.arm <> 'O'))"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are units, statuses of their orders arms: how many orders, and whether one of an even number."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderstatus").alias("arm"), (F.col("o_orderkey") % 2 == 0).cast("int").alias("even"))
    counts = orders.groupBy("unit", "arm").agg(F.count("*").alias("f1"), F.max("even").alias("em"))
    every = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit")).crossJoin(F.broadcast(orders.select("arm").distinct()))  # statuses are few
    return every.join(counts, ["unit", "arm"], "left").select("unit", "arm", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("f1", "em")])


def _shared(pairs: list[tuple[str, str]]) -> str:
    """CTEs from long: draws of all contrasts (arm, metric) that share their picks, their bounds and means."""
    wide = ", ".join(f"max(difference) FILTER (arm = '{a}' AND metric = '{m}') AS x{i}" for i, (a, m) in enumerate(pairs))
    each = ", ".join(f"{{'arm': '{a}', 'metric': '{m}', 'v': x{i} / n}}" for i, (a, m) in enumerate(pairs))
    columns = ", ".join(f"x{i}" for i in range(len(pairs)))
    return (
        f", wide AS (SELECT {wide} FROM long GROUP BY unit)"
        + drawn("", columns, ", ".join(f"sum(x{i}) AS x{i}" for i in range(len(pairs))), "wide")
        + f""", r0 AS (SELECT d, unnest([{each}]) AS e FROM m), r AS (SELECT e.arm AS arm, e.metric AS metric, d, e.v AS v, row_number() OVER (PARTITION BY e.arm, e.metric ORDER BY e.v) - 1 AS k FROM r0),
k AS (SELECT arm, metric, max(v) FILTER (k = {LO}) AS lo, max(v) FILTER (k = {HI}) AS hi FROM r GROUP BY arm, metric),
w AS (SELECT arm, metric, avg(difference) AS estimate, count(*) AS n_units FROM long GROUP BY ALL)"""
    )


_EFFECTS = _ARMS + _shared([(a, m) for a in ("F", "P") for m in ("f1", "em")])


@query(
    _EFFECTS
    + f""", x AS (SELECT arm, metric, (count(*) FILTER (abs(v - estimate) >= abs(estimate) - 1e-12) + 1) / {_DRAWS + 1}.0::DOUBLE AS p FROM r JOIN w USING (arm, metric) GROUP BY ALL),
h AS (SELECT *, (count(*) OVER (PARTITION BY metric) - row_number() OVER (PARTITION BY metric ORDER BY p, arm) + 1) * p AS step FROM x),
j AS (SELECT arm, metric, p, CASE WHEN metric = 'f1' THEN least(1.0::DOUBLE, max(step) OVER (PARTITION BY metric ORDER BY p, arm ROWS UNBOUNDED PRECEDING)) END AS adjusted FROM h)
SELECT arm, metric, round(estimate, 6) AS estimate, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 6) AS p, round(adjusted, 6) AS adjusted, n_units FROM w JOIN k USING (arm, metric) JOIN j USING (arm, metric)"""
)
def role_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every arm against the baseline in two metrics with shared draws; Holm over the first metric."""
    return _rounded(reports.family(_arms(spark, sf_dir), "arm", "unit", ["f1", "em"], "O", "f1", _DRAWS), "estimate", "lo", "hi", "p", "adjusted")


_COSTS = """
WITH long AS (SELECT event_type AS name, event_id, value FROM events)""" + _interval("name", "value", "v", "round(avg(value), 6) AS v")


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = stats.hashed_draws(read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "event_id", "value"), ["name"], "event_id", ["value"], _DRAWS)
    return draws.select("name", "draw", F.round(F.col("value") / F.col("n"), 6).alias("v"))


_RANKS = _COSTS + ", t AS (SELECT name, d, v, rank() OVER (PARTITION BY d ORDER BY v DESC) + (count(*) OVER (PARTITION BY d, v) - 1) / 2.0::DOUBLE AS k, max(v) OVER (PARTITION BY d) AS top, min(v) OVER (PARTITION BY d) AS low, count(*) OVER (PARTITION BY d, v) AS ties FROM r)"


@query(
    _RANKS
    + f""", o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k, d) - 1 AS i FROM t)
SELECT name, round(avg(k), 6) AS mean_rank, max(k) FILTER (i = round_even(0.025::DOUBLE * {_DRAWS - 1}, 0)) AS rank_lo, max(k) FILTER (i = round_even(0.975::DOUBLE * {_DRAWS - 1}, 0)) AS rank_hi,
  round(avg(CASE WHEN v = top THEN 1.0::DOUBLE / ties ELSE 0 END), 6) AS p_most, round(avg(CASE WHEN v = low THEN 1.0::DOUBLE / ties ELSE 0 END), 6) AS p_least FROM o GROUP BY name"""
)
def rank_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rank, its interval, and the chances of the first and the last place."""
    return _rounded(reports.rank_report(_costs(spark, sf_dir), "name", "v"), "mean_rank", "p_most", "p_least")


@query(_RANKS + f" SELECT name, k AS rank, round(count(*) / {_DRAWS}.0::DOUBLE, 6) AS p FROM t GROUP BY ALL")
def rank_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each name has each rank."""
    return _rounded(reports.rank_distribution(_costs(spark, sf_dir), "name", "v"), "p")


@query(_RANKS + " SELECT a.name, b.name AS other, round(avg((a.v > b.v)::INTEGER), 6) AS p_greater FROM t a JOIN t b ON a.d = b.d AND a.name <> b.name GROUP BY ALL")
def rank_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one name costs more than another."""
    return _rounded(reports.pairwise(_costs(spark, sf_dir), "name", "v"), "p_greater")


def _selector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses are configurations and metrics roles; O is the baseline."""
    arms = _arms(spark, sf_dir)
    base = F.when(F.col("arm") == "O", F.col("f1"))
    shared = arms.select("unit", base.alias("value")).where("value is not null").crossJoin(F.broadcast(spark.createDataFrame([("reader",), ("writer",)], "role string")))
    each = arms.where("arm <> 'O'").select("unit", F.col("arm").alias("configuration"), F.explode(F.create_map(F.lit("reader"), F.col("f1"), F.lit("writer"), F.col("em") * 2)).alias("role", "value"))
    return shared.withColumn("configuration", F.lit("O")).unionByName(each)


_SELECTOR = """
WITH arms AS (SELECT c_custkey AS unit, s.arm AS arm, coalesce(sum((o_orderstatus = s.arm)::INTEGER), 0)::DOUBLE AS f1, coalesce(max((o_orderstatus = s.arm AND o_orderkey % 2 = 0)::INTEGER), 0)::DOUBLE AS em
  FROM customer CROSS JOIN (SELECT DISTINCT o_orderstatus AS arm FROM orders) s LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
long AS (SELECT arm, unit, x.metric AS metric, x.d AS difference FROM (SELECT a.arm, a.unit, unnest([{'metric': 'reader', 'd': a.f1 - b.f1}, {'metric': 'writer', 'd': a.em * 2 - b.f1}]) AS x FROM arms a JOIN arms b ON a.unit = b.unit AND b.arm = 'O' WHERE a.arm <> 'O'))""" + _shared([(a, m) for m in ("reader", "writer") for a in ("F", "P")])


@query(_SELECTOR + """ SELECT metric AS role, arm AS configuration, round(estimate, 6) AS effect, round(lo, 6) AS lower FROM w JOIN k USING (arm, metric)
UNION ALL SELECT role, 'O', 0.0::DOUBLE, 0.0::DOUBLE FROM (VALUES ('reader'), ('writer')) t(role)""")
def selector_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of configurations in roles, all draws shared."""
    made = reports.selector_effects(_selector_rows(spark, sf_dir), "role", "configuration", "unit", "value", "O", _DRAWS)
    return made.select("role", "configuration", F.round("effect", 6).alias("effect"), F.round(F.get(F.sort_array("draws"), F.lit(int(0.025 * _DRAWS))), 6).alias("lower"))


@query(
    _CALLS
    + ", long AS (SELECT stage, role, 'passed' AS metric, question, sum(protocol_ok::INTEGER)::DOUBLE AS num, count(*)::DOUBLE AS den FROM calls GROUP BY ALL)"
    + _interval("stage, role, metric", "num, den", "num / den", "sum(num) AS num, sum(den) AS den")
    + """ SELECT stage, role, round(sum(num) / sum(den), 6) AS estimate, round(any_value(lo), 6) AS lower, count(*) AS n_units, sum(den)::BIGINT AS n, any_value(lo) >= 0.77 AS eligible FROM long JOIN k USING (stage, role) GROUP BY stage, role"""
)
def role_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which roles keep to the protocol by their clustered lower bound."""
    return _rounded(reports.eligible(_calls(spark, sf_dir), ["stage", "role"], "question", "protocol_ok", 0.77, _DRAWS), "estimate", "lower")


@query(
    _SELECTOR
    + f""", dr AS (SELECT metric AS role, arm AS configuration, d, v FROM r UNION ALL SELECT role, 'O', d, 0.0::DOUBLE FROM (VALUES ('reader'), ('writer')) t(role), range({_DRAWS}) s(d)),
ef AS (SELECT metric AS role, arm AS configuration, estimate AS effect FROM w UNION ALL SELECT role, 'O', 0.0::DOUBLE FROM (VALUES ('reader'), ('writer')) t(role)),
el AS (SELECT role, bool_or(eligible) AS ok FROM ({SQL["role_eligibility"]}) GROUP BY role),
al AS (SELECT ef.* FROM ef LEFT JOIN el USING (role) WHERE configuration = 'O' OR coalesce(ok, false)),
fp AS (SELECT o_orderstatus AS configuration, count(*)::DOUBLE AS footprint FROM orders GROUP BY 1),
y AS (SELECT a.configuration AS ca, b.configuration AS cb, round(a.effect + b.effect, 9) AS effect FROM al a JOIN al b ON a.role = 'reader' AND b.role = 'writer'),
lo AS (SELECT ca, cb, round(list_sort(list(da.v + db.v))[{LO + 1}], 9) AS lower FROM y JOIN dr da ON da.role = 'reader' AND da.configuration = ca JOIN dr db ON db.role = 'writer' AND db.configuration = cb AND db.d = da.d GROUP BY ca, cb)
SELECT ca || ',' || cb AS allocation, effect, lower, len(list_distinct([ca, cb]))::INTEGER AS n_configs, (SELECT sum(footprint) FROM fp WHERE list_contains([ca, cb], configuration)) AS footprint
FROM y JOIN lo USING (ca, cb) WHERE lower >= -{_MARGIN} ORDER BY footprint, effect DESC, n_configs, allocation LIMIT 1"""
)
def measured_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From measured effects and eligible roles to the cheapest assignment; a status costs as many as it has orders."""
    made = reports.selector_effects(_selector_rows(spark, sf_dir), "role", "configuration", "unit", "value", "O", _DRAWS)
    passed = reports.eligible(_calls(spark, sf_dir), ["stage", "role"], "question", "protocol_ok", 0.77, _DRAWS).groupBy("role").agg(F.bool_or("eligible").alias("ok"))
    allowed = made.join(passed, "role", "left").where((F.col("configuration") == "O") | F.coalesce("ok", F.lit(False)))
    memory = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("configuration")).agg(F.count("*").cast("double").alias("footprint"))
    return analytics.allocation(allowed, memory, ["reader", "writer"], _MARGIN)


_BATCHES = """
WITH b AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'base' WHEN o_orderkey % 3 = 1 THEN 'half' ELSE 'tiny' END AS run, o_orderstatus AS stage, o_custkey % 2 AS repeat, o_orderkey AS batch, round(o_totalprice * 100) AS wall, round(o_totalprice * 111) AS service, count(l_orderkey)::DOUBLE AS size, coalesce(sum(l_quantity), 0) AS prompt_tokens, coalesce(sum(l_linenumber), 0)::DOUBLE AS output_tokens
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are timed batches, their lineitems calls; times are whole numbers, so that any order of summing gives the same."""
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(F.count("*").alias("size"), F.sum("l_quantity").alias("prompt_tokens"), F.sum("l_linenumber").alias("output_tokens"))
    third = F.col("o_orderkey") % 3
    orders = read(spark, sf_dir, "orders").select(
        F.when(third == 0, "base").when(third == 1, "half").otherwise("tiny").alias("run"), F.col("o_orderstatus").alias("stage"), (F.col("o_custkey") % 2).alias("repeat"), F.col("o_orderkey").alias("batch"),
        F.round(F.col("o_totalprice") * 100).alias("wall"), F.round(F.col("o_totalprice") * 111).alias("service"),
    )
    return orders.join(items, "batch", "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("size", "prompt_tokens", "output_tokens")})


@query(
    _BATCHES
    + ", long AS (SELECT run, stage, 'wall' AS metric, batch, wall AS num, size AS den, prompt_tokens AS pt, output_tokens AS ot FROM b WHERE size > 0)"
    + _interval("run, stage, metric", "num, den", "num / den", "sum(num) AS num, sum(den) AS den")
    + """, w AS (SELECT run, stage, sum(num) / sum(den) AS estimate, count(*) AS n_batches FROM long GROUP BY ALL),
s AS (SELECT run, stage, sum(prompt_tokens) / sum(wall) AS pps, sum(output_tokens) / sum(wall) AS ops FROM b GROUP BY ALL)
SELECT w.run, w.stage, round(w.estimate, 6) AS estimate, round(lo, 6) AS lo, round(hi, 6) AS hi, w.n_batches, round(pps, 6) AS prompt_per_s, round(ops, 6) AS output_per_s, round(w.estimate / z.estimate, 6) AS ratio
FROM w JOIN k USING (run, stage) JOIN s USING (run, stage) LEFT JOIN w z ON z.stage = w.stage AND z.run = 'base'"""
)
def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds a call by stage with intervals, tokens a second, and the ratio to the baseline."""
    return _rounded(reports.stage_latency(_batches(spark, sf_dir), "run", "stage", "batch", "base", _DRAWS), "estimate", "lo", "hi", "prompt_per_s", "output_per_s", "ratio")


@query(
    _BATCHES
    + drawn("run, stage, repeat", "wall, service", "sum(wall) AS wall, sum(service) AS service", "b")
    + f""", long AS (SELECT run, 'generation' AS kind, wall AS seconds FROM b UNION ALL SELECT run, 'service', service FROM b),
q AS (SELECT run, count(*) AS q FROM b GROUP BY run), y AS (SELECT run, kind, d, sum(v) / any_value(q) AS v FROM (SELECT run, d, 'generation' AS kind, wall AS v FROM m UNION ALL SELECT run, d, 'service', service FROM m) JOIN q USING (run) GROUP BY run, kind, d),
yr AS (SELECT y.run, y.kind, y.v, y.v / z.v AS ratio FROM y JOIN y z ON z.run = 'base' AND z.kind = y.kind AND z.d = y.d),
yo AS (SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY v) - 1 AS i, row_number() OVER (PARTITION BY run, kind ORDER BY ratio) - 1 AS j FROM yr),
yk AS (SELECT run, kind, max(v) FILTER (i = {LO}) AS lo, max(v) FILTER (i = {HI}) AS hi, max(ratio) FILTER (j = {LO}) AS ratio_lo, max(ratio) FILTER (j = {HI}) AS ratio_hi FROM yo GROUP BY ALL),
w AS (SELECT run, kind, sum(seconds) / any_value(q) AS estimate, count(*) AS n_batches FROM long JOIN q USING (run) GROUP BY run, kind)
SELECT w.run, w.kind, round(w.estimate, 6) AS estimate, n_batches_of.n_batches, round(w.estimate / z.estimate, 6) AS ratio, round(lo, 6) AS lo, round(hi, 6) AS hi, round(ratio_lo, 6) AS ratio_lo, round(ratio_hi, 6) AS ratio_hi
FROM w JOIN yk USING (run, kind) JOIN (SELECT run, kind, n_batches FROM w) n_batches_of USING (run, kind) JOIN w z ON z.run = 'base' AND z.kind = w.kind"""
)
def system_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds a question, of generation and of the service, with ratios to the baseline draw by draw; a run's
    questions are as many as its batches."""
    batches = _batches(spark, sf_dir).withColumn("generation", F.col("wall"))
    questions = batches.groupBy("run").agg(F.count("*").alias("n"))
    return _rounded(reports.system_latency(batches, "run", ["stage", "repeat"], "batch", questions, "base", _DRAWS), "estimate", "lo", "hi", "ratio", "ratio_lo", "ratio_hi")


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY l_orderkey)
SELECT name, violations, violations = 0 AS ok FROM (
  SELECT 'batches_recorded_twice' AS name, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS violations
  UNION ALL SELECT 'batches_without_members', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
  UNION ALL SELECT 'sizes_of_members', (SELECT count(*) FROM orders JOIN n ON l_orderkey = o_orderkey WHERE c <> 4)
  UNION ALL SELECT 'calls_without_batch', (SELECT count(*) FROM (SELECT DISTINCT ps FROM (SELECT unnest(range(1, 8)) AS ps) WHERE ps NOT IN (SELECT l_linenumber FROM lineitem)))
  UNION ALL SELECT 'members_without_call', (SELECT count(*) FROM lineitem WHERE l_linenumber NOT BETWEEN 1 AND 7)
  UNION ALL SELECT 'calls_in_several_batches', (SELECT count(*) FROM (SELECT l_linenumber FROM lineitem GROUP BY l_linenumber HAVING count(DISTINCT l_orderkey) > 1))
  UNION ALL SELECT 'further_fingerprints', (SELECT count(DISTINCT o_orderpriority) - 1 FROM orders))""")
def batch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether recorded batches cover the calls, orders being batches of four lineitems, numbers of lines calls."""
    batches = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"), F.lit(4).alias("size"), "o_orderpriority")
    members = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("line"))
    calls = spark.range(1, 8).select(F.col("id").cast("int").alias("line"))
    return analytics.expectations(reports.batch_coverage(batches, members, calls, "batch", ["line"], "o_orderpriority"))


@query("""
WITH c AS (SELECT event_type AS stage, user_id % 5 AS repeat, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT DISTINCT event_type AS stage FROM events)
SELECT name, violations, violations = 0 AS ok FROM (
  SELECT 'repeats_missing' AS name, (SELECT count(*) FROM s CROSS JOIN range(4) t(repeat) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.stage = s.stage AND c.repeat = t.repeat)) AS violations
  UNION ALL SELECT 'repeats_recorded_twice', (SELECT count(*) FROM c WHERE n > 1) UNION ALL SELECT 'repeats_unexpected', (SELECT count(*) FROM c WHERE repeat > 3)
  UNION ALL SELECT 'call_graphs_differ', (SELECT count(*) FROM (SELECT event_type FROM events GROUP BY event_type HAVING count(DISTINCT props) > 1)))""")
def orchestration_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timing record for each stage and repeat, the same call graph in all."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 5).alias("repeat"), "props")
    return analytics.expectations(reports.orchestration_coverage(rows, "stage", "repeat", "props", rows, 4))
