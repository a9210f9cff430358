"""Cutting the lineage of tables that loops build on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder, which all executors share; a lost executor loses none of it.
    In local mode a folder of its own is set if none is."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
    return df.checkpoint()


#: Bytes of an Arrow batch between a JVM and its Python workers, which hold it several times as objects.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Has this session exchange Arrow batches of BATCH_BYTES, unless its context was given a size. Spark's own bounds, ten
    thousand rows or many more bytes, are too much for rows of whole texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


#: A side is broadcast if its rows, written as JSON, take at most so many bytes.
BROADCAST_BYTES = 24_000_000


def small(df: DataFrame) -> bool:
    """Whether df takes at most BROADCAST_BYTES. It is computed once for this, so it should be cut or cheap."""
    taken = df.select(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first().b
    return (taken or 0) <= BROADCAST_BYTES
