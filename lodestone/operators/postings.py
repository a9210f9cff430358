"""Postings of a corpus, written once and searched as often as needed.

Documents are indexed where they lie: a block is some tens of thousands of postings of neighbouring documents, one row of a table,
with the greatest impact of each of its terms. A search adds up, from these alone, what each block can give each query at most;
it scores the most promising blocks first and of the others only those that can still reach the k-th best score. What is skipped
is neither scored nor, if no query needs the block, read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import lineage

#: Postings of a block and documents of a slice, about.
BLOCK_POSTINGS, SLICE = 1 << 17, 2000
#: Blocks that are scored for each query before others are skipped.
FIRST = 2
#: Bytes of queries, about, that are sent to the tasks of one search.
QUERY_BYTES = 4 << 20
#: Rows of slices and blocks take a megabyte or more. A writer holds a row group and a reader all its rows at once, so groups are of few.
_FEW_ROWS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.row.count.limit": 4}
#: Digits that scores are ranked by.
DIGITS = 6


@dataclass
class Index:
    """An index: where it lies, how many documents it has and their mean length; and of the last search, how many pairs of
    query and block there were and how many of them were scored."""

    path: str
    id_kind: str
    n: int
    avgdl: float
    last: dict[str, int] = field(default_factory=dict)


def folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/postings-{uuid.uuid4().hex}"


def _sliced(part: pa.RecordBatch, asked: pa.Array | None) -> list:
    lists = part.column("tokens")
    coded = lists.flatten().dictionary_encode()
    codes, n = coded.indices.to_numpy(), len(part)
    length = pc.list_value_length(lists)
    doc = np.repeat(np.arange(n, dtype=np.int32), pc.fill_null(length, 0).to_numpy())
    if asked is not None and len(codes):
        real = pc.is_in(coded.dictionary, value_set=asked).to_numpy(zero_copy_only=False)[codes]
        codes, doc = codes[real], doc[real]
    key, tf = np.unique(codes.astype(np.int64) * max(1, n) + doc, return_counts=True)
    term, of = key // max(1, n), key % max(1, n)
    used, df = np.unique(term, return_counts=True)
    return [part.column("id"), length, coded.dictionary.take(pa.array(used, pa.int64())), df.astype(np.int32), of.astype(np.int32), tf.astype(np.int32)]


def build(docs: DataFrame, id_col: str, tokens: Column, asked: DataFrame | None = None, k1: float = 1.5, b: float = 0.75) -> Index:
    """An index of docs by their tokens, for all terms, or for those of asked (term) if they are few by their bytes. Texts are
    split once. A null text counts as a document, but not in the mean length; ids may repeat and be null."""
    spark, path, wanted = docs.sparkSession, folder(docs.sparkSession), None
    lineage.small_batches(spark)
    if asked is not None:
        terms = lineage.cut(asked.select("term").distinct())
        if lineage.small(terms):
            wanted = [r.term for r in terms.collect()]
    kind = dict(docs.dtypes)[id_col]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = None if wanted is None else pa.array(wanted, pa.string())
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                row = _sliced(batch.slice(lo, SLICE), few)
                yield pa.RecordBatch.from_arrays([_one(x) for x in row], names=["ids", "length", "terms", "df", "docs", "tf"])

    rows = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    rows.mapInArrow(slices, f"ids array<{kind}>, length array<int>, terms array<string>, df array<int>, docs array<int>, tf array<int>").write.options(**_FEW_ROWS).parquet(f"{path}/slices")
    sliced = spark.read.parquet(f"{path}/slices")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    known = F.filter("length", lambda x: x.isNotNull())
    n, sized, length = sliced.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.sum(F.size(known)), F.sum(total(known))).first()
    avgdl = length / sized if sized and length else 1.0
    each = sliced.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    each.write.parquet(f"{path}/df")

    def block(held: list[dict[str, pa.Array]], k: int) -> pa.RecordBatch:
        words = pa.concat_arrays([h["terms"] for h in held]).dictionary_encode()
        get = lambda name: np.concatenate([h[name].to_numpy(zero_copy_only=False) for h in held])
        ids = pa.concat_arrays([h["ids"] for h in held])
        sizes = pc.fill_null(pa.concat_arrays([h["length"] for h in held]), 0).to_numpy(zero_copy_only=False)
        base = np.cumsum([0, *(len(h["ids"]) for h in held)])
        term, doc, tf = np.repeat(words.indices.to_numpy(), get("df")), np.concatenate([h["docs"].to_numpy() + b_ for h, b_ in zip(held, base, strict=False)]), get("tf")
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order].astype(np.float64)
        x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / avgdl))
        starts = np.searchsorted(term, np.arange(len(words.dictionary) + 1))
        most = np.maximum.reduceat(x, starts[:-1]) if len(x) else np.zeros(0)
        number = (TaskContext.get().partitionId() << 24) + k
        blobs = [pa.array([a.tobytes()], pa.binary()) for a in (starts.astype("<i4"), doc.astype("<i4"), x.astype("<f8"), most.astype("<f8"))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), _one(ids), _one(words.dictionary), *blobs], names=["block", "ids", "terms", "starts", "docs", "impacts", "most"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings, k = [], 0, 0
        for batch in batches:
            for i in range(len(batch)):
                held.append({name: batch.column(name)[i].values for name in ("ids", "length", "terms", "df", "docs", "tf")})
                postings += len(held[-1]["docs"])
                if postings >= BLOCK_POSTINGS:
                    yield block(held, k)
                    held, postings, k = [], 0, k + 1
        if held:
            yield block(held, k)

    sliced.mapInArrow(blocks, f"block long, ids array<{kind}>, terms array<string>, starts binary, docs binary, impacts binary, most binary").write.options(**_FEW_ROWS).parquet(f"{path}/blocks")
    return Index(path, kind, n, avgdl)


def _one(values: pa.Array | np.ndarray) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def frequencies(spark: SparkSession, index: Index) -> DataFrame:
    """(term, df) of the terms that the index holds."""
    return spark.read.parquet(f"{index.path}/df")


def _placed(batch: pa.RecordBatch, i: int, vocabulary: list[str], queries: list[tuple[np.ndarray, np.ndarray]], mine: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places of its terms among the block's, their weights), for queries that share a term with the block."""
    at = pc.fill_null(pc.index_in(pa.array(vocabulary, pa.string()), value_set=batch.column("terms")[i].values), -1).to_numpy(zero_copy_only=False)
    for q in mine:
        terms, w = queries[q]
        known = at[terms] >= 0
        if known.any():
            yield q, at[terms][known], w[known]


def _bounded(blocks: DataFrame, vocabulary: list[str], queries: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(query, block, bound): what a document of the block can score at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                most = np.frombuffer(batch.column("most")[i].as_buffer(), "<f8")
                rows = [(q, float(most[at] @ w)) for q, at, w in _placed(batch, i, vocabulary, queries, list(range(len(queries))))]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int32()), pa.array([batch.column("block")[i].as_py()] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.float64())], names=["query", "block", "bound"])

    return blocks.select("block", "terms", "most").mapInArrow(run, "query int, block long, bound double")


def _scored(blocks: DataFrame, vocabulary: list[str], queries: list[tuple[np.ndarray, np.ndarray]], k: int, kind: str) -> DataFrame:
    """(query, id, score): the k best of each block for its queries (column mine)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                starts, docs, x = (np.frombuffer(batch.column(c)[i].as_buffer(), kind_) for c, kind_ in (("starts", "<i4"), ("docs", "<i4"), ("impacts", "<f8")))
                ids = batch.column("ids")[i].values
                rank = np.empty(len(ids), np.int64)
                rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
                score, found = np.zeros(len(ids)), []
                for q, at, w in _placed(batch, i, vocabulary, queries, batch.column("mine")[i].as_py()):
                    score[:] = 0
                    for term, weight in zip(at.tolist(), w.tolist(), strict=True):
                        lo, hi = starts[term], starts[term + 1]
                        score[docs[lo:hi]] += x[lo:hi] * weight
                    seen = np.flatnonzero(score)
                    rounded = np.round(score[seen], DIGITS)
                    if len(seen) > k:
                        near = rounded >= np.partition(rounded, len(seen) - k)[len(seen) - k]
                        seen, rounded = seen[near], rounded[near]
                    best = seen[np.lexsort([rank[seen], -rounded])[:k]]
                    found.append((np.full(len(best), q), best, score[best]))
                if found:
                    q, best, s = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), ids.take(pa.array(best)), pa.array(s)], names=["query", "id", "score"])

    return blocks.mapInArrow(run, f"query int, id {kind}, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("score", F.round("score", DIGITS)).withColumn("rank", rank).where(F.col("rank") <= k)


def search(spark: SparkSession, index: Index, weights: DataFrame, k: int) -> DataFrame:
    """(query, rank, id, score): the k best documents of each query by score to DIGITS digits, ties to the smaller id.
    weights: (query, term, weight), weights positive; a null query has no rows.

    Queries go in blocks of about QUERY_BYTES, so what the driver sends to tasks is bounded. The result is that of scoring
    every posting."""
    lineage.small_batches(spark)
    kept = lineage.cut(weights.where("query is not null"))
    size = kept.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    parts, out, kind = max(1, math.ceil(size / QUERY_BYTES)), None, dict(weights.dtypes)["query"]
    index.last = {"pairs": 0, "scored": 0}
    for part in range(parts):
        mine = kept.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("x"))
        rows = mine.select("query", "x.term", "x.weight").collect()
        found = _search(spark, index, [(r.term, r.weight) for r in rows], k)
        names = spark.createDataFrame([(i, r.query) for i, r in enumerate(rows)], f"_i int, _name {kind}")
        some = found.join(F.broadcast(names), F.col("query") == F.col("_i")).select(F.col("_name").alias("query"), "rank", "id", "score")  # as many as QUERY_BYTES hold
        out = some if out is None else out.unionByName(some)
    return out


def _search(spark: SparkSession, index: Index, items: list[tuple[list[str], list[float]]], k: int) -> DataFrame:
    vocabulary = sorted({t for terms, _ in items for t in terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    queries = [(np.array([place[t] for t in terms], np.int64), np.array(w, np.float64)) for terms, w in items]
    blocks = spark.read.parquet(f"{index.path}/blocks")
    pairs = _bounded(blocks, vocabulary, queries)
    first = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    pairs = lineage.cut(pairs.withColumn("nth", F.row_number().over(first)))

    def scored(some: DataFrame) -> DataFrame:
        asked = lineage.cut(some.groupBy("block").agg(F.collect_list("query").alias("mine")))
        index.last["scored"] += asked.agg(F.coalesce(F.sum(F.size("mine")), F.lit(0))).first()[0]
        side = F.broadcast(asked) if lineage.small(asked) else asked
        return lineage.cut(_scored(blocks.join(side, "block"), vocabulary, queries, k, index.id_kind))

    total, later = pairs.agg(F.count("*"), F.count_if(F.col("nth") > FIRST)).first()
    index.last["pairs"] += total
    found = scored(pairs.where(F.col("nth") <= FIRST))
    if later:
        least = _top(found, k).groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("least"))
        rest = pairs.where(F.col("nth") > FIRST).join(least, "query", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 2 * 10.0**-DIGITS)
        found = found.unionByName(scored(rest))
    return _top(found, k).select("query", "rank", "id", "score")


def search_beside(spark: SparkSession, index: Index, asked: DataFrame, weights: DataFrame, shared: DataFrame) -> DataFrame:
    """search() of queries that are a shared text and some terms of their own. asked (query, base, k), none null: a row for each query with its base and
    depth; weights (query, term, weight) of its own terms; shared (base, term, weight).

    A block is scored once for each base, however many queries have it. Own terms only add, so a document without any is found only
    if its base alone finds it as deep, and no document counts below the base's k-th score: a query looks at the postings of its own
    terms, and of no block that can't reach that score. The result is that of searching both together."""
    lineage.small_batches(spark)
    asked, weights, shared = lineage.cut(asked), lineage.cut(weights), lineage.cut(shared)
    deepest, kind = asked.agg(F.max("k")).first()[0] or 1, dict(asked.dtypes)["query"]
    alone = search(spark, index, shared.withColumnRenamed("base", "query"), deepest)
    ends = lineage.cut(alone.select(F.col("query").alias("base"), F.col("rank").alias("k"), F.col("score").alias("least")))
    listed = lambda df, by: df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("x")).select(by, F.col("x.term").alias("term"), F.col("x.weight").alias("weight"))
    parts = lambda size: max(1, math.ceil((size or 0) / QUERY_BYTES))
    of_base = parts(shared.agg(F.sum(F.octet_length("term") + 16)).first()[0])
    told = asked.join(listed(weights, "query"), "query", "left").join(ends, ["base", "k"], "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    told = lineage.cut(told.withColumn("_b", F.pmod(F.xxhash64("base"), F.lit(of_base))))
    taken = F.sum(F.aggregate(F.coalesce("term", F.array().cast("array<string>")), F.lit(32).cast("long"), lambda n, t: n + F.octet_length(t) + 16))
    sizes = {r["_b"]: r.size for r in told.groupBy("_b").agg(taken.alias("size")).collect()}  # a row for each QUERY_BYTES of shared texts
    terms = lineage.cut(listed(shared, "base").withColumn("_b", F.pmod(F.xxhash64("base"), F.lit(of_base))))
    out, scored = None, spark.sparkContext.accumulator(0)
    index.last = {"pairs": 0, "scored": 0}
    for b, size in sorted(sizes.items()):
        texts = {r.base: (r.term, r.weight) for r in terms.where(F.col("_b") == b).collect()}
        for part in range(parts(size)):
            rows = told.where((F.col("_b") == b) & (F.pmod(F.xxhash64("query"), F.lit(parts(size))) == part)).orderBy("base", "query").collect()
            if not rows:
                continue
            bases = sorted({r.base for r in rows})
            found = lineage.cut(_beside(spark, index, rows, [texts.get(x, ([], [])) for x in bases], scored))
            place = {x: i for i, x in enumerate(bases)}
            names = F.broadcast(spark.createDataFrame([(i, place[r.base], r.k, r.query) for i, r in enumerate(rows)], f"_i int, _base int, k int, _name {kind}"))  # as many as QUERY_BYTES hold
            first = found.where("query < 0").withColumn("nth", F.row_number().over(Window.partitionBy("base").orderBy(F.desc(F.round("score", DIGITS)), "id")))
            both = found.where("query >= 0").join(names, F.col("query") == F.col("_i")).unionByName(first.join(names, (F.col("base") == F.col("_base")) & (F.col("nth") <= F.col("k"))).drop("nth"))
            every = both.groupBy(F.col("_name").alias("query"), "k", "block", "doc", "id").agg(F.round(F.max("score"), DIGITS).alias("score"))
            best = every.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= F.col("k")).select("query", "rank", "id", "score")
            out = best if out is None else out.unionByName(best)
    index.last = {"pairs": asked.count() * spark.read.parquet(f"{index.path}/blocks").count(), "scored": scored.value}
    return search(spark, index, weights.limit(0), 1) if out is None else out


def _beside(spark: SparkSession, index: Index, rows: list, texts: list[tuple[list[str], list[float]]], scored: Accumulator) -> DataFrame:
    """(query, base, block, doc, id, score): of each block, the documents with own terms of a query that may be among its k best, and, with
    query -1, those that may be among the deepest of a base. rows are in the order of bases, as
    texts, their terms, are."""
    vocabulary = sorted({t for terms, _ in texts for t in terms} | {t for r in rows for t in r.term or []})
    place = {t: i for i, t in enumerate(vocabulary)}
    common = [(np.array([place[t] for t in terms], np.int64), np.array(w, np.float64)) for terms, w in texts]
    own = np.array([place[t] for r in rows for t in r.term or []], np.int64)
    weight = np.array([w for r in rows for w in r.weight or []], np.float64)
    ends = np.cumsum([0, *(len(r.term or []) for r in rows)])
    least, depth = np.array([r.least for r in rows]) - 2 * 10.0**-DIGITS, [r.k for r in rows]
    begin = np.cumsum([0, *(n for _, n in sorted(Counter(r.base for r in rows).items()))])

    def best(s: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
        rounded = np.round(s, DIGITS)
        at = np.arange(len(s))
        if len(s) > k:
            at = np.flatnonzero(rounded >= np.partition(rounded, len(s) - k)[len(s) - k])
        return at[np.lexsort([rank[at], -rounded[at]])[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                starts, docs, x, most = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("starts", "<i4"), ("docs", "<i4"), ("impacts", "<f8"), ("most", "<f8")))
                ids = batch.column("ids")[i].values
                rank = np.empty(len(ids), np.int64)
                rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
                at = pc.fill_null(pc.index_in(pa.array(vocabulary, pa.string()), value_set=batch.column("terms")[i].values), -1).to_numpy(zero_copy_only=False)
                held = at[own] >= 0
                adds = np.concatenate([[0.0], np.cumsum(np.where(held, np.append(most, 0.0)[at[own]] * weight, 0.0))])
                adds, any_held = adds[ends[1:]] - adds[ends[:-1]], np.diff(np.concatenate([[0], np.cumsum(held)])[ends]) > 0
                score, more, found = np.zeros(len(ids)), np.zeros(len(ids)), []
                for base, (terms, w) in enumerate(common):
                    mine = slice(begin[base], begin[base + 1])
                    score[:] = 0
                    for term, weighs in zip(at[terms].tolist(), w.tolist(), strict=True):
                        if term >= 0:
                            lo, hi = starts[term], starts[term + 1]
                            score[docs[lo:hi]] += x[lo:hi] * weighs
                    seen = np.flatnonzero((score > 0) & (score >= least[mine].min()))
                    seen = seen[best(score[seen], rank[seen], max(depth[mine]))]
                    found.append((np.full(len(seen), -1), np.full(len(seen), base), seen, score[seen]))
                    live = begin[base] + np.flatnonzero(any_held[mine] & (score.max(initial=0.0) + adds[mine] >= least[mine]))
                    scored.add(len(live))
                    for q in live.tolist():
                        held_by = []
                        for term, weighs in zip(at[own[ends[q] : ends[q + 1]]].tolist(), weight[ends[q] : ends[q + 1]].tolist(), strict=True):
                            if term >= 0:
                                lo, hi = starts[term], starts[term + 1]
                                more[docs[lo:hi]] += x[lo:hi] * weighs
                                held_by.append(docs[lo:hi])
                        seen = held_by[0] if len(held_by) == 1 else np.unique(np.concatenate(held_by))
                        s = score[seen] + more[seen]
                        more[seen] = 0
                        seen, s = seen[s >= least[q]], s[s >= least[q]]
                        if len(seen):
                            top = best(s, rank[seen], depth[q])
                            found.append((np.full(len(top), q), np.full(len(top), base), seen[top], s[top]))
                q, base, doc, s = (np.concatenate(c) for c in zip(*found, strict=True))
                block = pa.array(np.full(len(q), batch.column("block")[i].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(base, pa.int32()), block, pa.array(doc, pa.int32()), ids.take(pa.array(doc, pa.int64())), pa.array(s)], names=["query", "base", "block", "doc", "id", "score"])

    return spark.read.parquet(f"{index.path}/blocks").mapInArrow(run, f"query int, base int, block long, doc int, id {index.id_kind}, score double")
