"""Small models fitted on the driver from bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int) -> DataFrame:
    """Rows of docs (doc_id, text) with y: up to rows_per_class labelled ids of either class, picked by hash of the id, so
    the pick doesn't depend on order, and as many rows: where ids have several rows, different texts count once each, and
    those of the first ids by hash are taken. The bounded side is broadcast. Null ids and labels other than 0 and 1 are ignored."""
    picked = None
    for y in (0, 1):
        one = labels.where((F.col(label) == y) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__id"), F.lit(y).alias("y"))
        one = one.distinct().orderBy(F.xxhash64("__id"), "__id").limit(rows_per_class)
        picked = one if picked is None else picked.unionAll(one)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y")
    if max((r["count"] for r in rows.groupBy("y").count().collect()), default=0) <= rows_per_class:
        return rows
    keys, first = rows.select("y", "doc_id", F.xxhash64("text").alias("__text")).distinct(), None
    for y in (0, 1):
        one = keys.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "__text").limit(rows_per_class)
        first = one if first is None else first.unionAll(one)
    return rows.withColumn("__text", F.xxhash64("text")).join(F.broadcast(first), ["y", "doc_id", "__text"], "left_semi").select("doc_id", "text", "y").distinct()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton's method. With one class or no rows, only the
    constant, from the rate smoothed by one row of each class."""
    rate = (y.sum() + 1) / (len(y) + 2)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return w
    z, penalty = np.column_stack([x, np.ones(len(x))]), np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def rising(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """logistic() with no negative weight: with few rows, one of several features that say the same may get a negative one.
    The most negative is set to 0 and the rest is fitted again, until there is none."""
    use = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, use], y, ridge)
        if not use or w[:-1].min() >= 0:
            break
        use.pop(int(w[:-1].argmin()))
    out = np.zeros(x.shape[1] + 1)
    out[[*use, -1]] = w
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(z, -500, 500) / 2))
