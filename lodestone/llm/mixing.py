"""Mixing sources to target weights by systematic sampling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source and size are ranked in blocks of about this many rows or a BLOCK_SHARE of all rows.
BLOCK_ROWS, BLOCK_SHARE = 256, 50_000


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sizes (source, key, source_size) with rate and target. Sources weigh weights[0], weights[1], ... repeating, by code
    point, null last. The targets sum to share of all sizes unless every source is at its cap.

    Water filling: in order of cap * size / weight, the level of what is left for each unit of weight falls to the first
    source that it doesn't lift above its cap. There is a row for each source, so one task is enough.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.lit(list(map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumns({"most": cap * F.col("source_size"), "fill": cap * F.col("source_size") / F.col("w")})
    by_fill, every = Window.orderBy("fill", F.col("source").isNull(), "source"), Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weights_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumns({"nth": F.row_number().over(by_fill), "level": left / weights_left})
    level = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("nth", "level"))).over(every)["level"]
    s = s.withColumn("target", F.when(level.isNull(), F.col("most")).otherwise(F.least("most", F.col("w") * level)))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    return s.select("key", "source_size", "target", rate.alias("rate"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, size (words), source_size, target, copies, taken (copies * size).

    Every document of a source has the same expected number of copies, its target over its size, at most cap. Within a
    source the documents are ordered by size, then by md5 of doc_id; at the n-th, the running sum of expected copies is
    n times that rate. One offset in [0, 1) for each source, from seed and source, is added, and a document is taken once
    for each whole number that the sum passes at it. As like sizes lie together, the words taken come near the target;
    reruns agree. Defined results: a null text has size 0; null is a source of its own; rows with one doc_id, null too,
    are ranked one after the other; an empty table gives an empty result; other columns are ignored.

    Ranks come in two steps, so no source has to fit in a task: blocks of documents are counted and summed up within
    the source, then documents are ranked within blocks. Large groups of one source and size are cut by their md5.
    """
    tmp = shared.Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = tmp.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"), md5.alias("md5")), "sizes")
    sources = tmp.cut(targets(docs.groupBy("source", "key").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")

    rows = docs.count()
    like = docs.groupBy("key", "size").agg(F.count("*").alias("n"))
    limit = max(BLOCK_ROWS, rows // BLOCK_SHARE)
    digits = F.ceil(F.log(F.col("n") / F.lit(float(limit))) / F.log(F.lit(16.0))).cast("int")
    large = tmp.cut(like.where(F.col("n") > limit).select("key", "size", digits.alias("digits")), "large")
    cut = docs.join(shared.small(large), ["key", "size"], "left")
    cut = cut.withColumn("block", F.expr("substr(md5, 1, coalesce(digits, 0))")).drop("digits")
    before = Window.partitionBy("key").orderBy("size", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy("key", "size", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("key", "size", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    blocks = tmp.cut(blocks, "blocks")
    nth = F.row_number().over(Window.partitionBy("key", "size", "block").orderBy("md5", "doc_id"))
    ranked = cut.withColumn("nth", nth).join(shared.small(blocks), ["key", "size", "block"]).withColumn("nth", F.col("base") + F.col("nth"))
    ranked = ranked.join(shared.small(sources), "key")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("key"))), 1, 12), 16, 10).cast("double") / float(16**12)
    passed = lambda n: F.floor(n * F.col("rate") + offset)
    ranked = ranked.withColumn("copies", passed(F.col("nth")) - passed(F.col("nth") - 1))
    return ranked.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs with all its columns, each document as often as mix() takes it. Of rows with one doc_id each is taken as often
    as the first of them would be on average, that is, the group's copies are dealt over it."""
    tmp = shared.Scratch(spark, "mixed")
    taken = mix(spark, docs, **options).groupBy("doc_id").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    taken = tmp.cut(taken.withColumnRenamed("doc_id", "__id"), "taken")
    held = docs.join(shared.small(taken), F.col("doc_id").eqNullSafe(F.col("__id")))
    single = held.where("__rows = 1")
    if taken.where("__rows > 1").isEmpty():
        dealt = single
    else:
        # rows of one doc_id: each gets the quotient, the first ones one more
        w = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__")]))
        many = held.where("__rows > 1").withColumn("__nth", F.row_number().over(w))
        extra = F.when(F.col("__nth") <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
        many = many.withColumn("__copies", F.floor(F.col("__copies") / F.col("__rows")) + extra).drop("__nth")
        dealt = single.unionByName(many)
    repeated = dealt.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
