"""Scratch tables, checked broadcasts and connected components, shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its rows have been counted and take no more bytes than this.
BROADCAST_BYTES = 24 << 20
#: Bytes of text that a Python worker works on at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark opens the path, so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, where it is unset, one under /tmp."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


#: Bytes of an Arrow batch between a JVM and its Python workers, which hold it twice or more.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Has this session exchange Arrow batches of BATCH_BYTES, unless its context was given a size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Written tables that cut lineage. They lie in the shared folder, so a lost executor loses none of them."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base, self.n = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Removes a table made by cut() that nothing will read any more."""
        jvm = self.spark.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.base.removeprefix("file://") not in path:
                raise ValueError(f"{path} is not one of this scratch folder's tables")
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int | None = None, width: int | None = None) -> DataFrame:
    """df, marked for broadcast if its rows take at most BROADCAST_BYTES; beyond that Spark shuffles both sides. A row takes
    width bytes, or what its columns of fixed size take, and 32 for each other one."""
    fixed = {"bigint": 8, "double": 8, "int": 4, "float": 4, "boolean": 1}
    width = width or 8 + sum(fixed.get(f.dataType.simpleString(), 32) for f in df.schema)
    return F.broadcast(df) if (df.count() if rows is None else rows) * width <= BROADCAST_BYTES else df


#: What the functions of this Python worker keep between tasks, by name, and how to let go of it.
_kept: dict[str, Callable[[], object]] = {}


@contextlib.contextmanager
def worker(name: str, free: Callable[[], object] | None = None) -> Iterator[None]:
    """Around the work of a task in a Python worker. Workers serve one operator after another: what others keep between
    tasks is let go before, and memory that is no longer used goes back to the system after."""
    for other in [n for n in _kept if n != name]:
        _kept.pop(other)()
    if free:
        _kept[name] = free
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def parts(batch: pa.RecordBatch, column: str, rows: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most rows rows, whose texts take at most size bytes in all; one longer text is a slice of its own."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(batch):
        before = int(ends[at - 1]) if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node of an edge between two different
    nodes; component is the smallest node that can be reached. Nulls make no edge. Only DataFrame operations.

    Each round points every node at its smallest neighbour or itself, follows the pointers to their roots by doubling,
    and contracts the edges to the roots. Every root that still has an edge gains or loses members in a round, so the
    number of rounds is logarithmic. Aggregates combine before they shuffle, and the joins read written tables on both
    sides, so Spark can split a node that has a large share of all edges.
    """
    e = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct()
    e, labels = scratch.cut(e, "edges"), None
    while not e.isEmpty():
        both = e.select(F.col("v").alias("n"), F.col("u").alias("p")).unionAll(e.select(F.col("u").alias("n"), F.col("u").alias("p")))
        p = scratch.cut(both.groupBy("n").agg(F.min("p").alias("p")), "parents")
        while True:
            jump = p.join(p.select(F.col("n").alias("p"), F.col("p").alias("q")), "p")
            if jump.where("p <> q").isEmpty():
                break
            longer = scratch.cut(jump.select("n", F.col("q").alias("p")), "parents")
            scratch.drop(p)
            p = longer
        if labels is None:
            labels = p.select(F.col("n").alias("node"), F.col("p").alias("component"))
        else:
            up = p.select(F.col("n").alias("component"), F.col("p").alias("up"))
            labels = scratch.cut(labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        pu, pv = p.select(F.col("n").alias("u"), F.col("p").alias("x")), p.select(F.col("n").alias("v"), F.col("p").alias("y"))
        rest = e.join(pu, "u").join(pv, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        rest = scratch.cut(rest, "edges")
        scratch.drop(e)
        e = rest
    if labels is None:
        labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
