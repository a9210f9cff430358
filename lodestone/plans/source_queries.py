"""Queries that write artifacts and read them back, and streams over tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..streaming import log
from .registry import query, read


def _folder(spark: SparkSession) -> str:
    """A folder of this query's own in the shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/artifacts-{uuid.uuid4().hex}"


@query("SELECT conv_id::VARCHAR AS question_id, role AS stage, turn AS call_index, text AS raw_output, 'agent_call' AS record_type FROM conversations")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON Lines, some without a kind, read with one schema."""
    path = f"{_folder(spark)}/log"
    c = read(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 2 == 0, "agent_call")
    c.select(kind.alias("record_type"), F.col("conv_id").cast("string").alias("question_id"), F.col("role").alias("stage"), F.col("turn").alias("call_index"), F.col("text").alias("raw_output")).write.json(path)
    return files.run(files.legacy(files.json_lines(spark, path)))["calls"].select("question_id", "stage", "call_index", "raw_output", "record_type")


@query("SELECT 'first' AS pass, count(DISTINCT (user_id, event_type)) AS n FROM events UNION ALL SELECT 'again', 0")
def append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appending the same records twice adds them once."""
    path, events = f"{_folder(spark)}/store", read(spark, sf_dir, "events").select("user_id", "event_type", "value")
    n = [files.append_new(events, path, ["user_id", "event_type"]) for _ in range(2)]
    return spark.createDataFrame([("first", n[0]), ("again", n[1])], "pass string, n long")


@query("SELECT p_brand AS run_id, 'a/' || p_brand AS accuracy_path, CASE WHEN p_brand LIKE '%1' THEN 't/' || p_brand END AS timing_path FROM part GROUP BY p_brand")
def run_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and timing halves of runs, side by side."""
    runs = read(spark, sf_dir, "part").select(F.col("p_brand").alias("run_id")).distinct()
    accuracy = runs.select("run_id", F.lit(False).alias("timing_mode"), F.concat(F.lit("a/"), "run_id").alias("path"))
    timing = runs.where("run_id like '%1'").select("run_id", F.lit(True).alias("timing_mode"), F.concat(F.lit("t/"), "run_id").alias("path"))
    only = spark.createDataFrame([("none", True, "t/none")], "run_id string, timing_mode boolean, path string")
    return files.discover(accuracy.unionByName(timing).unionByName(only))


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS n FROM part) WHERE n <= 3")
def stage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each group, as a report shows them."""
    return files.samples(read(spark, sf_dir, "part"), ["p_brand"], ["p_size", "p_partkey"], 3).select("p_brand", "p_partkey", "p_size")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its file, or of the files of its folder. A pattern fits both: Spark takes a plain path for a folder."""
    schema = read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """Everything that the stream holds now, with the batch that gave it, written to files by the executors. Each batch has a
    folder of its own, which a batch that is run again replaces, so no row comes twice."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    running = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/batch=-1")  # a table without files has no batch
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{kinds}, batch long").parquet(f"{folder}/out")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming S11 B04: each key once."""
    once = log.once(_stream(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])
    return _run(once, "append").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming: counts by day of event time."""
    daily = log.windowed(_stream(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day")
    last = _run(daily, "update").groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "x.n", F.round("x.total", 4).alias("total"))


@query("""
WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS want FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
r AS (SELECT conv_id, max(turn) + 1 AS executed FROM u WHERE want = turn GROUP BY conv_id)
SELECT conv_id, least(executed, 4) AS executed, CASE WHEN executed >= 4 THEN 'semantic_inability' ELSE 'open' END AS stop_reason FROM r""")
def stream_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming B06 B11: steps of each conversation without a gap; turn 3 says no."""
    c = _stream(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("step"), F.when(F.col("turn") == 3, "no").otherwise("yes").alias("success"))
    last = _run(log.histories(c, "conv_id"), "update")
    return last.groupBy("conv_id").agg(F.max("executed").alias("executed"), F.max_by("stop_reason", "executed").alias("stop_reason"))
