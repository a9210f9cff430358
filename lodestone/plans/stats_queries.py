"""Queries over labels, events and orders: metrics, intervals and bootstraps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stats
from .registry import query, read

_SCORED = "WITH s AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, (d.n_chars % 1000) / 1000.0::DOUBLE AS c FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 1000 / 1000.0).alias("c"))
    return docs.join(read(spark, sf_dir, "labels"), "doc_id")


@query(
    _SCORED
    + """, r AS (SELECT quality, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS k FROM s),
t AS (SELECT sum(quality) AS p, count(*) - sum(quality) AS n, sum(CASE WHEN quality = 1 THEN k END) AS w FROM r)
SELECT round((w - p * (p + 1) / 2.0) / (p * n), 9) AS auroc, p::BIGINT AS n_pos, n::BIGINT AS n_neg FROM t"""
)
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well length tells quality."""
    return stats.auroc(_scored(spark, sf_dir), "c", "quality").withColumn("auroc", F.round("auroc", 9))


@query(
    _SCORED
    + """, b AS (SELECT c, quality, (SELECT count(*) FROM range(1, 10) t(i) WHERE c > i / 10.0::DOUBLE) AS bin FROM s),
g AS (SELECT bin, count(*) AS n, avg(c) AS c, avg(quality) AS y FROM b GROUP BY bin)
SELECT round(sum(n * abs(y - c)) / sum(n), 9) AS ece, sum(n)::BIGINT AS n FROM g"""
)
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of length as a probability of quality."""
    return stats.calibration_error(_scored(spark, sf_dir), "c", "quality").withColumn("ece", F.round("ece", 9))


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = floor(0.025::DOUBLE * n)) AS lo, max(value) FILTER (i = least(floor((1 - 0.05::DOUBLE / 2) * n), n - 1)) AS hi, max(n) AS n FROM r GROUP BY event_type""")
def order_stat_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-statistic interval of event values."""
    return stats.order_interval(read(spark, sf_dir, "events"), ["event_type"], "value")


@query("""
WITH p AS (SELECT event_type, 'u' || (user_id % 7) AS name, round(((avg(value) * 1000)::BIGINT % 100) / 400.0 + 0.001, 6)::DOUBLE AS p FROM events GROUP BY ALL),
s AS (SELECT *, (count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY p, name) + 1) * p AS step FROM p)
SELECT event_type, name, p, round(least(1.0, max(step) OVER (PARTITION BY event_type ORDER BY p, name ROWS UNBOUNDED PRECEDING)), 9)::DOUBLE AS adjusted FROM s""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down adjustment within families."""
    name = F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"))
    p = F.round(F.round(F.avg("value") * 1000).cast("long") % 100 / 400.0 + 0.001, 6)
    families = read(spark, sf_dir, "events").groupBy("event_type", name.alias("name")).agg(p.alias("p"))
    return stats.holm(families, ["event_type"], "name", "p").withColumn("adjusted", F.round("adjusted", 9))


_R = stats.REPLICATES
#: Places from 0 of the bounds of an interval among the draws.
LO, HI = int(0.025 * _R), min(int(0.975 * _R), _R - 1)


def _word(kind: str, number: str) -> str:
    return f"('0x' || substr(md5('0|{kind}|' || {number}), 1, 8))::UBIGINT"


def drawn(strata: str, values: str, sums: str, table: str = "long") -> str:
    """CTEs from a table (strata, values): u, units in order of their values; m (strata, d, sums, n), sums over the units
    that hashes of stratum, place and draw pick."""
    by, on = (f"PARTITION BY {strata} ", f"{strata}, ") if strata else ("", "")
    salt = f"('0x' || substr(md5(concat_ws('|', {strata})), 1, 8))::UBIGINT" if strata else "0::UBIGINT"
    return f""", u AS (SELECT *, row_number() OVER ({by}ORDER BY {values}) - 1 AS i, count(*) OVER ({by}) AS n FROM {table}),
p0 AS (SELECT {on}d, u.n, xor(w, v) AS x FROM (SELECT {on}n, xor({_word("p", "i")}, {salt}) AS w FROM u) u CROSS JOIN (SELECT d, {_word("d", "d")} AS v FROM range({_R}) t(d)) t),
p1 AS (SELECT {on}d, n, (xor(x, x >> 16) * 2246822507) & 4294967295 AS x FROM p0),
p2 AS (SELECT {on}d, n, (xor(x, x >> 13) * 3266489909) & 4294967295 AS x FROM p1),
p AS (SELECT {on}d, ((xor(x, x >> 16) * n) >> 32)::BIGINT AS i FROM p2),
m AS (SELECT {on}d, {sums}, count(*) AS n FROM p JOIN u USING ({on}i) GROUP BY {on}d)"""


@query(
    _SCORED
    + drawn("lang", "quality", "avg(quality) AS q", "s")
    + f""", r AS (SELECT lang, q, row_number() OVER (PARTITION BY lang ORDER BY q) - 1 AS k FROM m)
SELECT lang, round(max(q) FILTER (k = {LO}), 9) AS lo, round(max(q) FILTER (k = {HI}), 9) AS hi, count(*) AS n FROM r GROUP BY lang"""
)
def bootstrap_mean_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of mean quality by language, portable draws."""
    draws = stats.hashed_draws(_scored(spark, sf_dir), ["lang"], "doc_id", ["quality"], _R)
    means = draws.withColumn("q", F.col("quality") / F.col("n"))
    out = stats.draw_interval(means, ["lang"], "q")
    return out.select("lang", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n")


@query(
    _SCORED
    + ", x AS (SELECT quality - toxic AS d1, toxic - CASE WHEN c > 0.5 THEN 1 ELSE 0 END AS d2 FROM s)"
    + drawn("", "d1, d2", "avg(d1) AS d1, avg(d2) AS d2", "x")
    + f""", l AS (SELECT 'd1' AS contrast, d1 AS v, (SELECT avg(d1) FROM x) AS e FROM m UNION ALL SELECT 'd2', d2, (SELECT avg(d2) FROM x) FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY v) - 1 AS k FROM l)
SELECT contrast, round(max(e), 9) AS estimate, round(max(v) FILTER (k = {LO}), 9) AS lo, round(max(v) FILTER (k = {HI}), 9) AS hi,
  round((count(*) FILTER (abs(v - e) >= abs(e) - 1e-12) + 1) / {_R + 1}.0::DOUBLE, 9)::DOUBLE AS p FROM r GROUP BY contrast"""
)
def paired_bootstrap_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two contrasts over the same documents share their draws."""
    x = _scored(spark, sf_dir).select("doc_id", (F.col("quality") - F.col("toxic")).alias("d1"), (F.col("toxic") - (F.col("c") > 0.5).cast("int")).alias("d2"))
    draws = stats.hashed_draws(x, [], "doc_id", ["d1", "d2"], _R)
    long = draws.select(F.explode(F.array(*[F.struct(F.lit(d).alias("contrast"), (F.col(d) / F.col("n")).alias("v")) for d in ("d1", "d2")])).alias("s")).select("s.*")
    means = x.agg(F.avg("d1").alias("d1"), F.avg("d2").alias("d2")).select(F.explode(F.array(*[F.struct(F.lit(d).alias("contrast"), F.col(d).alias("estimate")) for d in ("d1", "d2")])).alias("s")).select("s.*")
    far = F.count_if(F.abs(F.col("v") - F.col("estimate")) >= F.abs("estimate") - 1e-12)
    p = long.join(F.broadcast(means), "contrast").groupBy("contrast", "estimate").agg(((far + 1) / (_R + 1.0)).alias("p"))
    out = p.join(stats.draw_interval(long, ["contrast"], "v"), "contrast")
    return out.select("contrast", *[F.round(c, 9).alias(c) for c in ("estimate", "lo", "hi", "p")])


@query(
    "WITH c AS (SELECT user_id, sum((event_type = 'click')::INTEGER)::BIGINT AS num, count(*) AS den FROM events GROUP BY user_id)"
    + drawn("", "num, den", "sum(num) / sum(den) AS v", "c")
    + f""", r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM m)
SELECT (SELECT count(*) FROM c) AS clusters, round((SELECT sum(num) / sum(den) FROM c), 9) AS estimate, round(max(v) FILTER (k = {LO}), 9) AS lo, round(max(v) FILTER (k = {HI}), 9) AS hi FROM r"""
)
def clustered_ratio_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of clicks, users being the clusters."""
    c = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum((F.col("event_type") == "click").cast("long")).alias("num"), F.count("*").alias("den"))
    draws = stats.hashed_draws(c, [], "user_id", ["num", "den"], _R).select(F.lit(1).alias("g"), (F.col("num") / F.col("den")).alias("v"))
    whole = c.agg(F.count("*").alias("clusters"), (F.sum("num") / F.sum("den")).alias("estimate"))
    out = stats.draw_interval(draws, ["g"], "v").crossJoin(F.broadcast(whole))  # a row each
    return out.select("clusters", *[F.round(x, 9).alias(x) for x in ("estimate", "lo", "hi")])


@query(
    "WITH b AS (SELECT event_type, value FROM events)"
    + drawn("event_type", "value", "sum(value) AS v", "b")
    + " SELECT d::INTEGER AS draw, round(sum(v) / (SELECT count(DISTINCT user_id) FROM events), 6) AS seconds FROM m GROUP BY d"
)
def stratified_time_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are drawn within their stage, times summed over stages and put per question; every event is a
    batch, every user a question."""
    events = read(spark, sf_dir, "events")
    users = events.agg(F.countDistinct("user_id").alias("users"))
    draws = stats.hashed_draws(events, ["event_type"], "event_id", ["value"], _R)
    total = draws.groupBy("draw").agg(F.sum("value").alias("v")).crossJoin(F.broadcast(users))
    return total.select("draw", F.round(F.col("v") / F.col("users"), 6).alias("seconds"))


@query()
def bootstrap_mean_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M06 M07 M08 exact mode: mean quality and toxicity by language."""
    return stats.exact_means(_scored(spark, sf_dir), ["lang"], "doc_id", ["quality", "toxic"])


@query(
    _SCORED
    + drawn("source", "quality", "round(avg(quality), 9) AS q", "s")
    + """, r AS (SELECT source, d, rank() OVER (PARTITION BY d ORDER BY q DESC) + (count(*) OVER (PARTITION BY d, q) - 1) / 2.0 AS k, q,
  max(q) OVER (PARTITION BY d) AS top, count(*) OVER (PARTITION BY d, q) AS ties FROM m)
SELECT source, round(avg(k), 6)::DOUBLE AS mean_rank, round(avg(CASE WHEN q = top THEN 1.0 / ties ELSE 0 END), 6)::DOUBLE AS p_most FROM r GROUP BY source"""
)
def rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of sources over draws, and the chance to be first, ties split."""
    draws = stats.hashed_draws(_scored(spark, sf_dir), ["source"], "doc_id", ["quality"], _R).withColumn("q", F.round(F.col("quality") / F.col("n"), 9))
    ranked = draws.select("source", "draw", "q", stats.ranks_with_ties(draws, ["draw"], "q").alias("k"), F.max("q").over(Window.partitionBy("draw")).alias("top"), F.count("*").over(Window.partitionBy("draw", "q")).alias("ties"))
    most = F.when(F.col("q") == F.col("top"), 1.0 / F.col("ties")).otherwise(0.0)
    return ranked.groupBy("source").agg(F.round(F.avg("k"), 6).alias("mean_rank"), F.round(F.avg(most), 6).alias("p_most"))
