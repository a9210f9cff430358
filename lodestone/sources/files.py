"""Reading and writing run artifacts: manifests, JSON Lines logs, discovery of finished runs, idempotent appends, reports."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: The columns that records of all kinds have between them; a kind leaves the others null.
RECORD = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("question_id", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("call_index", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("raw_output", T.StringType()), T.StructField("em", T.DoubleType()), T.StructField("f1", T.DoubleType()), T.StructField("predicted_answer", T.StringType()), T.StructField("gold_answer", T.StringType()),
    T.StructField("batch_id", T.StringType()), T.StructField("batch_wall_s", T.DoubleType()), T.StructField("members", T.ArrayType(T.StructType([T.StructField("question_id", T.StringType()), T.StructField("call_index", T.LongType())]))),
])


def first_that_loads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The Parquet table at the first path that has one; an error that names all of them if none has."""
    problems = []
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            problems.append(f"{path}: {str(e).splitlines()[0]}")
    raise ValueError("no source can be read: " + "; ".join(problems))


def column(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One column of a Parquet table; the others aren't read."""
    return spark.read.parquet(path).select(name)


def json_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Records of JSON Lines files; blank lines are skipped, a line that isn't JSON is an error when it is read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): lines of JSON Lines files that aren't JSON."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).where("trim(line) <> ''")
    return rows.where(F.try_parse_json("line").isNull())


def legacy(df: DataFrame) -> DataFrame:
    """Records of older logs have no record_type: those with a raw output are calls, others answers."""
    kind = F.when(F.col("raw_output").isNotNull(), "agent_call").when(F.col("predicted_answer").isNotNull(), "answer")
    return df.withColumn("record_type", F.coalesce("record_type", kind))


def run(df: DataFrame) -> dict[str, DataFrame]:
    """A run's records by kind, telemetry left out."""
    return {name: df.where(F.col("record_type") == kind) for name, kind in (("calls", "agent_call"), ("answers", "answer"), ("batches", "batch"), ("timings", "stage_timing"))}


def run_violations(answers: DataFrame, calls: DataFrame, em: Column, f1: Column, tolerance: float = 1e-12) -> dict[str, DataFrame]:
    """What must not be in a run: keys twice, metrics that differ from em and f1 computed anew, more than one run."""
    key = ["question_id", "stage", "call_index"]
    off = lambda a, b: F.abs(F.coalesce(a, F.lit(-1.0)) - b) > tolerance
    return {
        "calls_once": calls.groupBy(*key).count().where("count > 1"), "answers_once": answers.groupBy("question_id").count().where("count > 1"),
        "metrics_match": answers.where(off(F.col("em"), em) | off(F.col("f1"), f1)), "one_run": answers.agg(F.countDistinct("run_id").alias("n")).where("n > 1"),
    }


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(pos, question_id) in the manifest's order, from a list or an object with question_ids or ids. Ids have to be
    non-empty strings, none twice, and agree with the hash that the object gives, if it does. Manifests are small enough
    for a driver; they are read through Spark, so any store will do."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    body = json.loads(text)
    ids = body if isinstance(body, list) else body.get("question_ids") or body.get("ids")
    if not isinstance(ids, list) or not ids or not all(isinstance(i, str) and i for i in ids):
        raise ValueError(f"{path}: ids have to be non-empty strings")
    if len(set(ids)) < len(ids):
        raise ValueError(f"{path}: an id occurs twice")
    for name in ("question_ids_sha256", "ids_sha256", "sha256") if isinstance(body, dict) else ():
        if name in body and body[name] != hashlib.sha256("\n".join(ids).encode()).hexdigest():
            raise ValueError(f"{path}: {name} doesn't agree with the ids")
    return spark.createDataFrame(list(enumerate(ids)), "pos long, question_id string")


def cohort(questions: DataFrame, selected: DataFrame, excluded: list[DataFrame]) -> DataFrame:
    """Questions of a manifest with their pos, without those of other manifests."""
    out = questions.join(selected, "question_id")
    for e in excluded:
        out = out.join(e.select("question_id"), "question_id", "left_anti")
    return out


def discover(meta: DataFrame, **wanted: object) -> DataFrame:
    """(run_id, accuracy_path, timing_path): runs whose metadata agrees with wanted, their accuracy and timing halves side by
    side. Two files for one half are an error; timing without accuracy is dropped."""
    for name, value in wanted.items():
        meta = meta.where(F.col(name) == value)
    n = F.count("*").over(Window.partitionBy("run_id", "timing_mode"))
    path = F.when(n > 1, F.raise_error(F.concat(F.lit("two artifacts for run "), "run_id")).cast("string")).otherwise(F.col("path"))
    checked = meta.withColumn("path", path)
    halves = checked.groupBy("run_id").agg(F.max(F.when(~F.col("timing_mode"), F.col("path"))).alias("accuracy_path"), F.max(F.when(F.col("timing_mode"), F.col("path"))).alias("timing_path"))
    return halves.where("accuracy_path is not null")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file; each is hashed where it is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def completed(meta: DataFrame, hashes: DataFrame, answers: DataFrame, selected: DataFrame) -> DataFrame:
    """Run ids whose file is the one that its metadata names and whose answers are exactly those of the manifest."""
    name = F.element_at(F.split("path", "/"), -1)
    intact = meta.join(hashes.select(name.alias("file"), F.col("sha256").alias("found")), "file").where("found = sha256")
    have = answers.groupBy("run_id").agg(F.sort_array(F.collect_set("question_id")).alias("ids"), F.count("*").alias("n"))
    want = selected.agg(F.sort_array(F.collect_set("question_id")).alias("want"))
    return intact.join(have, "run_id").crossJoin(F.broadcast(want)).where((F.col("ids") == F.col("want")) & (F.col("n") == F.size("want"))).select("run_id")


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose key the Parquet table at path doesn't hold yet, and gives their number. Running it again
    appends nothing: a stopped append leaves no part behind, as files appear when the job commits."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    try:
        have = spark.read.parquet(path).select(*keys)
    except AnalysisException:
        have = None
    if have is not None:
        new = new.join(have, keys, "left_anti")
    before = 0 if have is None else have.count()
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def write_atomic(path: str, content: str) -> None:
    """Writes a small local file so that readers see all of it or what was there before."""
    part = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(part, "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def markdown(title: str, df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; more than most rows are an error, so nothing is left out unseen."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title} has more than {most} rows")
    show = lambda v: "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(line) + " |" for line in [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in rows]]]
    return f"## {title}\n\n" + "\n".join(lines) + "\n"


def report(sections: dict[str, DataFrame], folder: str) -> None:
    """report.json and report.md of small tables."""
    data = {name: [json.loads(x) for x in df.toJSON().collect()] for name, df in sections.items()}
    write_atomic(f"{folder}/report.json", json.dumps(data, indent=1, sort_keys=True, ensure_ascii=False))
    write_atomic(f"{folder}/report.md", "\n".join(markdown(name, df) for name, df in sections.items()))


def config(path: str) -> dict:
    """A YAML file; PyYAML is needed for this one only."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def samples(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group: what a person looks at."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
