"""Passage corpora: first-wins union, checks, sentence index, fingerprint, rendering, coverage of gold sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import lineage


def first_wins(sources: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Rows of all sources, one for each key: the one of the earliest source, and in it the first by order.

    The winner is found by an aggregate over (source, order), which combines before it shuffles, so a key that a large
    share of the rows has is no load on one task.
    """
    rows = reduce(lambda a, b: a.unionByName(b), [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)])
    others = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct("source_no", *order))
    return rows.groupBy(key).agg(first.alias("row")).select(key, "row.*")


def numbered(df: DataFrame, order: list[str], out: str = "corpus_idx") -> DataFrame:
    """df with its place in order, from 0. Places come from counts of ranges and ranks within them, so no task has all
    rows."""
    ranged = lineage.cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # read twice: the ranges have to stay
    ranged = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.max("_row").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ranged.join(F.broadcast(sizes.select("_part", "_base")), "_part").withColumn(out, (F.col("_base") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_base")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number: empty for a valid corpus."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require(df: DataFrame, key: str) -> DataFrame:
    """df itself, if it has rows and no key twice; else an error that names up to five keys, in order."""
    if df.isEmpty():
        raise ValueError("the corpus is empty")
    twice = [r[0] for r in duplicates(df, key).orderBy(key).limit(5).collect()]
    if twice:
        raise ValueError(f"keys occur more than once: {twice}")
    return df


def unnest(df: DataFrame, *arrays: str) -> DataFrame:
    """A row for each place of arrays that run in parallel, with pos from 0."""
    zipped = df.select(*[c for c in df.columns if c not in arrays], F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_z"))
    return zipped.select("*", *[F.col("_z")[a].alias(a) for a in arrays]).drop("_z")


def sentence_index(passages: DataFrame, id_col: str, sentences: Column, only: DataFrame | None = None) -> DataFrame:
    """(id, sent_id, text, norm) of all sentences whose normal form isn't empty, sent_id being the place among all; only:
    ids to keep."""
    if only is not None:
        passages = passages.join(only.select(id_col), id_col, "left_semi")
    rows = passages.select(id_col, F.posexplode(sentences).alias("sent_id", "text"))
    return rows.withColumn("norm", text.norm(F.col("text"))).where("norm <> ''").withColumn("sent_id", F.col("sent_id").cast("long"))


def fingerprint(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: rows and a SHA-256 that depends on every row and on their order by id. Rows are hashed where they are;
    hashes are hashed in order by blocks of a thousand ids, those by blocks of a thousand blocks, and so once more, so only
    a hash for each thousand million ids meets the others."""
    line = F.sha2(F.concat_ws("\x1f", F.col(id_col).cast("string"), F.col(text_col)), 256)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "\n")
    level = df.select(F.col(id_col).alias("at"), line.alias("h"), F.lit(1).alias("n"))
    for _ in range(3):
        level = level.groupBy(F.floor(F.col("at") / 1000).alias("block")).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("block", "at")
    return level.agg(F.sum("n").alias("n_rows"), F.sha2(joined, 256).alias("sha256"))


def rendered(ranked: DataFrame, by: str, rank: str, title: str, body: str) -> DataFrame:
    """(by, passages): "[rank] title: body" lines in order of rank."""
    line = F.format_string("[%d] %s: %s", F.col(rank).cast("long"), F.col(title).cast("string"), F.col(body))
    lines = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("k"), line.alias("line"))))
    return ranked.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("passages"))


def gold_coverage(gold: DataFrame, index: DataFrame, id_col: str) -> DataFrame:
    """gold (id, sent_id, text) with status: "equal" if the indexed sentence is the same, "equivalent" if only white space
    or case of composition differs, "missing" or "different" else."""
    have = index.select(id_col, "sent_id", F.col("text").alias("_have"))
    a, b = F.col("text"), F.col("_have")
    status = F.when(b.isNull(), "missing").when(a == b, "equal").when(text.collapse(a) == text.collapse(b), "equivalent").otherwise("different")
    return gold.join(have, [id_col, "sent_id"], "left").withColumn("status", status).drop("_have")
