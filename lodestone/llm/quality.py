"""Document quality: a text classifier whose evidence is combined with posteriors of hosts and their paths."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fitting, shared

#: The classifier is fitted on at most so many labelled documents of either class.
SAMPLE_ROWS = 10_000
#: Documents whose posterior probability of being good is below this are rejected.
KEEP_FROM = 0.3
#: Pseudo-documents by which a site leans to what is above it: bounds of the estimate.
LEAST_PRIOR, MOST_PRIOR = 5.0, 1000.0
SLICE = 1000

_BYTES = np.zeros((256, 9))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"|", b"!", b"%&*$#@^~<>{}[]\\/=+_", b".,;:?'\"()-", b"\n")):
    _BYTES[list(_chars), _k] = 1
_BYTES[128:, 8] = 1


def features(text: str | None) -> list[float]:
    """Shares of kinds of bytes, length, word length and repetition of words, pairs of words and lines; whole texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _BYTES / max(len(data), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct, again = len(set(words)), sum(map(operator.eq, words[1:], words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    length = np.log1p(n)
    kinds = np.log1p(distinct)
    line = sum(map(len, set(lines))) / max(sum(map(len, lines)), 1)
    mean = sum(map(len, words)) / max(n, 1)
    return [*share.tolist(), length, kinds, kinds / max(length, 1.0), distinct / max(n, 1), pairs / max(n - 1, 1), again / max(n - 1, 1), line, np.log1p(len(lines)), min(mean, 40.0), float(n == 0), float(n < 5)]


class Classifier:
    """Logistic regression on standardised features and their squares."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(features(""))), np.ones(len(features(""))))
        self.weights = fitting.logistic(self._of(x), y)

    def _of(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x.reshape(-1, len(self.mean)) - self.mean) / self.scale, -6, 6)
        return np.column_stack([z, z * z - 1])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.column_stack([self._of(x), np.ones(len(x))]) @ self.weights, -12, 12)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Classifier:
    """Fitted on the features of a bounded sample; the texts stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shared.worker("quality"):
            for batch in batches:
                x = [features(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = fitting.labelled(docs, labels, label, SAMPLE_ROWS).mapInArrow(run, "doc_id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["x"]))
    return Classifier(np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(features(""))), np.array([r["y"] for r in rows], np.float64))


def logits(docs: DataFrame, model: Classifier, text_col: str = "text", out_col: str = "doc_logit", keep_text: bool = True) -> DataFrame:
    """docs, every row with all its columns, the text only with keep_text, and the classifier's log-odds that the document
    is good."""
    kept = docs.drop(out_col)
    names = [c for c in kept.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shared.worker("quality"):
            for batch in batches:
                for part in shared.parts(batch, text_col, SLICE):
                    z = model.logits(np.array([features(t.as_py()) for t in part.column(text_col)]))
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(z)], names=[*names, out_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names), f"`{out_col}` double"])
    return kept.mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, above: Column) -> Column:
    """Pseudo-documents of the prior of groups (n, good), by moments: what the groups' rates vary beyond what counting
    alone would make them vary; little variation means a strong prior."""
    rate = F.col("good") / F.col("n")
    varies = F.sum(F.col("n") * (rate - above) ** 2 - above * (1 - above)) / F.greatest(F.sum("n") - F.count("*"), F.lit(1.0))
    level = F.sum(F.col("n") * above * (1 - above)) / F.sum("n")
    return F.least(F.greatest(level / F.greatest(varies, F.lit(1e-9)) - 1, F.lit(LEAST_PRIOR)), F.lit(MOST_PRIOR))


def sites(scored: DataFrame, tmp: shared.Scratch) -> DataFrame:
    """For each (host, path) of scored (host, path, p): host_rate and path_rate, posterior means of the share of good
    documents, and base, the global one. Hosts lean to the base and paths to their host, the more the fewer documents
    they have. Counts are combined before they are shuffled, so a host may hold any share of the rows."""
    paths = tmp.cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    hosts = tmp.cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    base = hosts.agg((F.sum("good") / F.sum("n")).alias("base"))
    hosts = hosts.crossJoin(F.broadcast(base))  # base is one row
    strength = hosts.agg(_strength(hosts, F.col("base")).alias("k"))
    hosts = hosts.crossJoin(F.broadcast(strength)).select("host", "base", ((F.col("k") * F.col("base") + F.col("good")) / (F.col("k") + F.col("n"))).alias("host_rate"))
    paths = paths.join(shared.small(tmp.cut(hosts, "host-rates")), "host")
    strength = paths.agg(_strength(paths, F.col("host_rate")).alias("k"))
    paths = paths.crossJoin(F.broadcast(strength))
    return paths.select("host", "path", "base", "host_rate", ((F.col("k") * F.col("host_rate") + F.col("good")) / (F.col("k") + F.col("n"))).alias("path_rate"))


def _site(df: DataFrame, host_col: str, path_col: str) -> DataFrame:
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return df.withColumns({"__host": known(host_col), "__path": known(path_col)})


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """docs (the named columns, or all) with doc_logit, host_rate, path_rate, score and keep.

    score is the posterior probability that the document is good: the classifier's log-odds, which stand for the base
    rate, moved to the rate of the document's path. Host and path rates are empirical-Bayes posteriors from the
    classifier's probabilities of all documents of the site, the document itself included. keep: score >= KEEP_FROM. Defined results: null or empty
    texts have features of their own and are scored like any; null hosts and paths are sites; rows with null or repeated
    ids are judged one by one; without labels the base rate is one half; an empty table gives an empty result; columns
    with the new names are replaced.
    """
    tmp = shared.Scratch(spark, "quality")
    new = ["doc_logit", "host_rate", "path_rate", "score", "keep"]
    model = train(docs.select("doc_id", "text"), labels)
    kept = [c for c in (columns or docs.columns) if c not in new]
    narrow = columns is not None and "text" not in columns
    needed = docs.select(*dict.fromkeys([*kept, host_col, path_col, "text"]))
    # each text is scored once; what is read twice is written
    scored = tmp.cut(_site(logits(needed, model, out_col="__logit", keep_text=not narrow), host_col, path_col), "logits")
    p = 1 / (1 + F.exp(-F.col("__logit")))
    known = tmp.cut(sites(scored.select(F.col("__host").alias("host"), F.col("__path").alias("path"), p.alias("p")), tmp), "sites")
    known = known.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("base").alias("__base"), F.col("host_rate").alias("__hr"), F.col("path_rate").alias("__pr"))
    out = scored.join(shared.small(known), ["__host", "__path"], "left")
    moved = 1 / (1 + F.exp(-(F.col("__logit") + _logit(F.col("__pr")) - _logit(F.col("__base")))))
    return out.select(*kept, F.col("__logit").alias("doc_logit"), F.col("__hr").alias("host_rate"), F.col("__pr").alias("path_rate"), moved.alias("score"), (moved >= KEEP_FROM).alias("keep"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """docs, with exactly its columns, without the rejected documents. Every row is judged by itself, those with null or
    repeated ids too; an empty table gives an empty result."""
    # what is decided hangs on text, host and path alone, so narrow rows are judged and the rejected ones taken out
    tmp, text = shared.Scratch(spark, "keep-good"), F.col("text")
    key = {"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(1), text), "__h": F.col(host_col), "__p": F.col(path_col)}
    given = docs.select("doc_id", "text", *(c.alias(n) for n, c in key.items()))
    gone = judge(spark, given, labels, "__h", "__p", columns=list(key)).where("not keep").select(*key).distinct()
    gone = shared.small(tmp.cut(gone, "gone"))
    return docs.join(gone, functools.reduce(operator.and_, [c.eqNullSafe(gone[n]) for n, c in key.items()]), "left_anti")
