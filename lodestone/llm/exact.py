"""Exact dedup: counting quotient filters find fingerprints that occur more than once, bytes decide about their texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quotients, shared

#: Fingerprints that one merged filter holds, about, and that a worker gathers before it gives its filters away.
BLOCK_ROWS, GATHERED = 1 << 16, 1 << 20


def normal(text: Column) -> Column:
    """What is compared: each stretch of white space is one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def filters(fingerprints: DataFrame, rows: int, column: str = "fp") -> DataFrame:
    """(block, filter, entries, documents): the counting quotient filters of all fingerprints, one for each block of them
    by their upper bits, of about BLOCK_ROWS. Each partition folds its own to filters first, so a fingerprint that a third of
    all rows have is one entry of each; those of a block are merged in one task."""
    lead = max(0, math.ceil(math.log2(max(1, rows) / BLOCK_ROWS)))

    def fold(fps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every, counts = np.unique(np.concatenate(fps), return_counts=True)
        block = every >> np.uint64(64 - lead) if lead else np.zeros(len(every), np.uint64)
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(every) else np.zeros(0, np.int64)
        for some in np.array_split(cuts, max(1, len(cuts) // 4096)):
            ends = [int(np.searchsorted(block, block[a], "right")) for a in some]
            blobs = [quotients.encode(every[a:b], counts[a:b], lead) for a, b in zip(some, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block[some].astype(np.int64)), pa.array(blobs, pa.binary())], names=["block", "filter"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, held = [], 0
        with shared.worker("quotients"):
            for batch in batches:
                fps.append(batch.column(0).to_numpy().view(np.uint64))
                held += len(batch)
                if held >= GATHERED:
                    yield from fold(fps)
                    fps, held = [], 0
            if held:
                yield from fold(fps)

    def merge(group: pa.Table) -> pa.Table:
        blob = quotients.merge(group.column("filter").to_pylist(), lead)
        _, counts = quotients.decode(blob)
        return pa.table({"block": group.column("block")[:1], "filter": pa.array([blob], pa.binary()), "entries": pa.array([len(counts)], pa.int64()), "documents": pa.array([int(counts.sum())], pa.int64())})

    pieces = fingerprints.select(column).mapInArrow(build, "block long, filter binary")
    return pieces.groupBy("block").applyInArrow(merge, "block long, filter binary, entries long, documents long")


def repeated(merged: DataFrame) -> DataFrame:
    """(fp): fingerprints that filters() counted more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("filter").to_pylist():
                fps, counts = quotients.decode(blob)
                yield pa.RecordBatch.from_arrays([pa.array(fps[counts > 1].view(np.int64))], names=["fp"])

    return merged.select("filter").mapInArrow(run, "fp long")


def duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id (the smallest id among rows of equal text), group_size, kept and
    text_sha256, of the normal form.

    Fingerprints, digests and ids are written once. Counting quotient filters tell which fingerprints occur more than once;
    only texts of these are compared, byte by byte, by grouping them by their bytes, which folds the copies of each partition
    before anything is shuffled. Defined results: a null text counts as empty; exactly one row of a group is kept: of several
    rows that share its smallest id any one, the others are equal; null ids count as larger than all others; an empty
    table gives an empty result; other columns are ignored. Long texts are never cut.
    """
    tmp = shared.Scratch(spark, "exact")
    text = docs.select(F.col(id_col).alias("doc_id"), normal(F.col(text_col)).alias("t"))
    rows = text.select("doc_id", F.xxhash64("t").alias("fp"), F.unhex(F.sha2("t", 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    rows = tmp.cut(rows, "fingerprints")
    again = tmp.cut(repeated(tmp.cut(filters(rows, rows.count()), "filters")), "repeated")
    routed = text.withColumn("fp", F.xxhash64("t")).join(shared.small(again), "fp", "left_semi")
    same = routed.groupBy("fp", "t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    same = tmp.cut(same.select("fp", F.unhex(F.sha2("t", 256)).alias("sha"), "keep_id", "group_size"), "groups")
    n = same.count()
    # of rows that share the smallest id, the first stays; the id is a key of this join, so groups of copies don't meet in it
    at = [rows["fp"] == same["fp"], rows["sha"] == same["sha"], rows["doc_id"].eqNullSafe(same["keep_id"])]
    first = rows.join(shared.small(same, n, 80), at).groupBy(same["fp"], same["sha"], same["keep_id"], "group_size").agg(F.min("row").alias("first"))
    found = rows.join(shared.small(tmp.cut(first, "first"), n, 96), ["fp", "sha"], "left")
    whole = F.col("group_size").isNull()
    return found.select("doc_id", F.when(whole, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (whole | (F.col("row") == F.col("first"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
