"""Invariants over orders and lineitems, and churn between two ways of answering them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import invariants
from .registry import query, read


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, sum(l_quantity) AS q, max(l_shipdate) < min(l_shipdate) AS back FROM lineitem GROUP BY l_orderkey)
SELECT name, violations, violations = 0 AS ok FROM (
  SELECT 'quantity_positive' AS name, (SELECT count(*) FROM lineitem WHERE l_quantity <= 0) AS violations UNION ALL SELECT 'discount_in_range', (SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.08)
  UNION ALL SELECT 'price_known', (SELECT count(*) FROM lineitem WHERE l_extendedprice IS NULL) UNION ALL SELECT 'flag_known', (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))
  UNION ALL SELECT 'lines_differ', (SELECT count(*) FROM g WHERE d < n) UNION ALL SELECT 'lines_from_one', (SELECT count(*) FROM g WHERE lo <> 1) UNION ALL SELECT 'few_lines', (SELECT count(*) FROM g WHERE n > 6)
  UNION ALL SELECT 'enough_pieces', (SELECT count(*) FROM g WHERE q < 20))""")
def table_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of rows and of orders, in one pass over the lines."""
    rows = {"quantity_positive": F.col("l_quantity") <= 0, "discount_in_range": (F.col("l_discount") < 0) | (F.col("l_discount") > 0.08), "price_known": F.col("l_extendedprice").isNull(), "flag_known": ~F.col("l_returnflag").isin("A", "N")}
    n = F.count("*")
    groups = {"lines_differ": F.count_distinct("l_linenumber") < n, "lines_from_one": F.min("l_linenumber") != 1, "few_lines": n > 6, "enough_pieces": F.sum("l_quantity") < 20}
    return invariants.checked(read(spark, sf_dir, "lineitem"), rows, ["l_orderkey"], groups)


@query("""
WITH a AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders), b AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(a.place, b.place)::BIGINT AS place, a.k AS "left", b.k AS "right" FROM a FULL JOIN b ON a.place = b.place WHERE a.k IS DISTINCT FROM b.k""")
def ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where orders by date, some left out, aren't in the order of their keys."""
    orders = read(spark, sf_dir, "orders")
    return invariants.order_differences(orders, orders.where("o_orderstatus <> 'P'"), "o_orderkey", ["o_orderkey"], ["o_orderdate", "o_orderkey"])


@query("""
WITH m AS (SELECT o_orderpriority AS run, avg(o_totalprice) AS price, avg((o_orderstatus = 'O')::INTEGER) AS open FROM orders GROUP BY 1), b AS (SELECT * FROM m WHERE run = (SELECT min(run) FROM m)),
l AS (SELECT run, unnest([{'metric': 'price', 'value': price, 'lim': -2000.0::DOUBLE}, {'metric': 'open', 'value': open, 'lim': 0.0::DOUBLE}]) AS x FROM m), z AS (SELECT 'price' AS metric, price AS base FROM b UNION ALL SELECT 'open', open FROM b)
SELECT run, x.metric AS metric, round(x.value, 6) AS value, round(base, 6) AS base, round(x.value - base, 6) AS delta, x.value - base >= x.lim AS passed FROM l JOIN z ON z.metric = x.metric WHERE run <> (SELECT run FROM b)""")
def gate_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run gained or lost against the first, and whether that is allowed."""
    runs = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.avg("o_totalprice").alias("price"), F.avg((F.col("o_orderstatus") == "O").cast("int")).alias("open"))
    base = runs.agg(F.min("run")).first()[0]
    return invariants.deltas(runs, "run", base, {"price": -2000.0, "open": 0.0}).withColumns({c: F.round(c, 6) for c in ("value", "base", "delta")})


#: Orders are calls; statuses are stages. One run answers with an order's own priority, the other with the greatest of its
#: customer's; a high price means that the strict form failed and the answer was salvaged or fell back.
_CALLS = """
WITH s AS (SELECT *, max(o_orderpriority) OVER (PARTITION BY o_custkey) AS best FROM orders),
a AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'extractor' WHEN 'O' THEN 'qa' END AS concept, CASE WHEN o_totalprice < 250000 THEN o_orderpriority END AS st, o_orderpriority AS ef, CASE WHEN o_totalprice < 250000 THEN 'parsed' ELSE 'salvaged' END AS route FROM s WHERE o_orderstatus <> 'P'),
b AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'extractor' WHEN 'O' THEN 'qa' END AS concept, CASE WHEN o_totalprice < 150000 THEN best END AS st, best AS ef, CASE WHEN o_totalprice < 150000 THEN 'parsed' ELSE 'fallback' END AS route FROM s WHERE o_orderstatus <> 'P' AND o_totalprice > 20000)"""


@query(
    _CALLS
    + """ SELECT coalesce(a.concept, b.concept) AS concept, count(a.k) AS n_left, count(b.k) AS n_right, count(*) FILTER (a.k = b.k) AS n_both, count(*) FILTER (a.st IS NOT NULL AND b.st IS NOT NULL) AS strict,
  count(*) FILTER (a.st <> b.st) AS strict_changed, count(*) FILTER (a.ef <> b.ef) AS effective_changed, count(*) FILTER (a.route <> b.route) AS route_changed FROM a FULL JOIN b ON a.k = b.k GROUP BY 1"""
)
def conceptual_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by what they are for, and what changed in strict and in effective payloads and routes."""
    orders = read(spark, sf_dir, "orders")
    best = orders.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("best"))
    calls = orders.join(best, "o_custkey").withColumn("role", F.when(F.col("o_orderstatus") == "P", "plan_summary").when(F.col("o_orderstatus") == "F", "extractor").otherwise("qa"))
    stages = spark.createDataFrame([("F", "extractor", 0, "extractor"), ("O", "qa", 0, "qa"), ("P", "plan_summary", 0, "plan_summary")], "stage string, concept string, step int, role string")

    def run(rows: DataFrame, answer: str, strictly: float, other: str) -> DataFrame:
        strict = F.col("o_totalprice") < strictly
        made = rows.select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("stage"), "role", F.when(strict, F.col(answer)).alias("strict"), F.col(answer).alias("effective"), F.when(strict, "parsed").otherwise(other).alias("route"))
        return invariants.conceptual(made, stages, ["question_id"])

    return invariants.churn(run(calls, "o_orderpriority", 250_000, "salvaged"), run(calls.where("o_totalprice > 20000"), "best", 150_000, "fallback"), ["question_id"])
