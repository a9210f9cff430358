"""Ranked lexical search over a tiered index.

Documents are indexed where they lie: a shard is a few megabytes of postings of neighbouring documents, one row of a table. A
term's postings stand in order of impact and are cut into tiers, the highest first, each with a bound for what the lower ones
hold. A tier's columns are read only by the searches that need it. An item whose best documents are proved exact by the
bounds stays there; the others fall through to the next tier, and the last one proves all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import shared

#: What parts terms: every ASCII character that is no letter or digit.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are split at a time, and documents.
SLICE_BYTES, SLICE = 2 << 20, 20_000
#: Postings of a shard, about.
SHARD_POSTINGS = 1 << 19
#: For each tier but the last: a term's postings of highest impact in a shard, so many at least, or one in so many.
TIERS = ((16, 16), (128, 4))
#: Bytes of items, about, that are sent to the tasks of one search.
ITEM_BYTES = 4 << 20

_SLICE = "used long, length long, ids array<long>, n array<int>, terms array<string>, df array<int>, docs array<int>, tf array<int>"
_PARTS = ("starts", "docs", "impacts", "bounds")


@dataclass
class Index:
    """Where an index lies, and its totals: documents with a term, terms of all documents."""

    path: str
    documents: int
    length: int


def terms_of(texts: pa.Array) -> pa.ListArray:
    """Terms of texts, A-Z in lower case; a text that begins or ends with a gap has an empty one there."""
    return pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), GAP)


def _sliced(ids: pa.Array, texts: pa.Array, asked: pa.Array | None) -> list:
    """A slice of documents: totals, ids, sizes, and the postings (document, occurrences) of each term, in order of terms."""
    lists = terms_of(texts)
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    known = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(lists).to_numpy())
    real = known[codes] if len(codes) else np.zeros(0, bool)
    n = np.bincount(doc[real], minlength=len(texts))
    if asked is not None and len(codes):
        real &= pc.is_in(words, value_set=asked).to_numpy(zero_copy_only=False)[codes]
    key = codes[real].astype(np.int64) * len(texts) + doc[real]
    del lists, coded, codes, doc, real
    key, tf = np.unique(key, return_counts=True)
    term, of = key // max(1, len(texts)), key % max(1, len(texts))
    used, df = np.unique(term, return_counts=True)
    return [int((n > 0).sum()), int(n.sum()), ids.to_pylist(), n.tolist(), words.take(pa.array(used, pa.int64())).to_pylist(), df.tolist(), of.astype(np.int32), tf.astype(np.int32)]


def slices(docs: DataFrame, id_col: str, text_col: str, asked: list[str] | None) -> DataFrame:
    """A row for each slice of docs; with asked, only postings of these terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if asked is None else pa.array(asked, pa.string())
        schema = pa.schema([("used", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
        with shared.worker("lexical"):
            for batch in batches:
                for part in shared.parts(batch, "text", SLICE, SLICE_BYTES):
                    row = _sliced(part.column("id"), part.column("text"), wanted)
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind.type) for x, kind in zip(row, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SLICE)


def impact(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What an occurrence count counts in a document of n terms, for a term of weight 1; below a million."""
    m = 50 + (50 * n.astype(np.int64) * documents) // max(1, length)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


def _tiered(term: np.ndarray, doc: np.ndarray, x: np.ndarray, terms: int, tiers: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    """For each tier starts, docs and impacts of each term's postings, and the highest impact that the lower tiers hold."""
    order = np.lexsort([doc, -x, term])
    term, doc, x = term[order], doc[order], x[order]
    begin = np.searchsorted(term, np.arange(terms + 1))
    df, nth = np.diff(begin), np.arange(len(term)) - begin[term]
    out, lo = [], np.zeros(terms, np.int64)
    for least, share in (*tiers, (0, 1)):
        hi = np.minimum(df, np.maximum(np.maximum(least, -(-df // share)), lo))
        mine = (nth >= lo[term]) & (nth < hi[term])
        rest = begin[:-1] + hi
        bounds = np.where(hi < df, x[np.minimum(rest, len(x) - 1)] if len(x) else 0, 0)
        out += [np.concatenate([[0], np.cumsum(hi - lo)]), doc[mine], x[mine], bounds]
        lo = hi
    return [a.astype("<i4") for a in out]


_COLUMNS = [f"{part}{tier}" for tier in range(len(TIERS) + 1) for part in _PARTS]


def _shards(sliced: DataFrame, documents: int, length: int) -> DataFrame:
    """(shard, ids, terms, ...): slices that follow each other, until they hold SHARD_POSTINGS, as one shard."""

    def shard(held: list[dict], k: int) -> pa.RecordBatch:
        words = pa.concat_arrays([h["terms"] for h in held]).dictionary_encode()
        # terms in order of their first slice; postings keep the slice's order
        term = np.repeat(words.indices.to_numpy(), np.concatenate([h["df"] for h in held]))
        base = np.cumsum([0, *(len(h["n"]) for h in held)])
        doc = np.concatenate([h["docs"] + b for h, b in zip(held, base, strict=False)])
        x = impact(np.concatenate([h["tf"] for h in held]), np.concatenate([h["n"] for h in held])[doc], documents, length)
        ids = pa.concat_arrays([h["ids"] for h in held])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        blobs = [pa.array([a.tobytes()], pa.binary()) for a in _tiered(term, doc, x, len(words.dictionary), TIERS)]
        number = (TaskContext.get().partitionId() << 24) + k
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(ids), one(words.dictionary), *blobs], names=["shard", "ids", "terms", *_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings, k = [], 0, 0
        with shared.worker("lexical"):
            for batch in batches:
                for i in range(len(batch)):
                    row = {n: batch.column(n)[i].values for n in ("ids", "n", "terms", "df", "docs", "tf")}
                    held.append({n: v if n in ("ids", "terms") else v.to_numpy() for n, v in row.items()})
                    postings += len(held[-1]["docs"])
                    if postings >= SHARD_POSTINGS:
                        yield shard(held, k)
                        held, postings, k = [], 0, k + 1
            if held:
                yield shard(held, k)

    schema = ", ".join(["shard long, ids array<long>, terms array<string>", *(f"{c} binary" for c in _COLUMNS)])
    return sliced.select("ids", "n", "terms", "df", "docs", "tf").mapInArrow(run, schema)


def _few(df: DataFrame, least: int = 0) -> DataFrame:
    """df in no more partitions than twice the cluster's cores, or least: what is written is then no heap of tiny files."""
    return df.coalesce(max(least, 2 * df.sparkSession.sparkContext.defaultParallelism))


def build(spark: SparkSession, docs: DataFrame, path: str, asked: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Writes the index of docs to path. asked (term): if these take at most shared.BROADCAST_BYTES, postings of other
    terms aren't made; else, or without asked, those of all terms are.

    Texts are split once; nothing is shuffled but a count for each term and slice. A null text has no term; rows with a
    null or repeated id are documents of their own; an empty table makes an empty index.
    """
    wanted = None
    if asked is not None:
        terms = asked.select("term").distinct()
        if (terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0) <= shared.BROADCAST_BYTES:
            wanted = [r.term for r in terms.collect()]
    slices(docs, id_col, text_col, wanted).write.parquet(f"{path}/slices")
    sliced = spark.read.parquet(f"{path}/slices")
    documents, length, postings = sliced.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("used"), F.col("length"), F.size("docs"))]).first()
    each = sliced.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    _few(each).write.parquet(f"{path}/df")
    # many small files would make as many small shards, each with its own best documents of every item
    _shards(_few(sliced, math.ceil(postings / SHARD_POSTINGS)), documents, length).write.parquet(f"{path}/shards")
    return Index(path, documents, length)


def weighted(spark: SparkSession, index: Index, asked: DataFrame) -> DataFrame:
    """(item_id, term, w): the terms of asked (item_id, term), once each, that some document holds and that count."""
    df = spark.read.parquet(f"{index.path}/df")
    n = F.lit(float(2 * index.documents + 2))
    w = F.floor(1000 * F.log(n / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return asked.select("item_id", "term").distinct().join(df, "term").select("item_id", "term", w.alias("w")).where("w > 0")


_FOUND = "item int, shard long, ids array<long>, scores array<long>, exact array<boolean>, most long"
_NULL = np.iinfo(np.int64).min


def _scored(shards: DataFrame, items: list[tuple[list[str], list[int]]], tier: int, k: int) -> DataFrame:
    """(item, shard, ids, scores, exact, most): for each item (its terms and weights) and shard the k best documents by what
    the tiers so far hold, whether that is all they have, and the most that any document that isn't exact may reach."""
    vocabulary = sorted({t for terms, _ in items for t in terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    coded = [(np.array([place[t] for t in terms], np.int64), np.array(w, np.int64)) for terms, w in items]

    def search(row: dict, batch: pa.RecordBatch, i: int, mine: list[int]) -> Iterator[tuple]:
        levels = [[np.frombuffer(batch.column(f"{part}{t}")[i].as_buffer(), "<i4") for part in _PARTS] for t in range(tier + 1)]
        at = pc.index_in(pa.array(vocabulary, pa.string()), value_set=batch.column("terms")[i].values)
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.column("ids")[i].values, _NULL).to_numpy()
        score, covered = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for item in mine:
            terms, w = coded[item]
            terms, w = at[terms][at[terms] >= 0], w[at[terms] >= 0]
            if not len(terms):
                continue
            score[:], covered[:], bound = 0, 0, 0
            for term, weight in zip(terms.tolist(), w.tolist(), strict=True):
                rest = int(levels[tier][3][term]) * weight
                bound += rest
                for starts, docs, impacts, _ in levels:
                    lo, hi = starts[term], starts[term + 1]
                    if lo < hi:
                        score[docs[lo:hi]] += impacts[lo:hi].astype(np.int64) * weight
                        if rest:
                            covered[docs[lo:hi]] += rest
            seen = np.flatnonzero(score)
            # a document that a term's tiers so far don't hold may still have what the rest of that term's postings have at most
            missing = bound - covered[seen]
            most = max(bound, int((score[seen] + missing)[missing > 0].max(initial=0)))
            if len(seen) > k:
                least = np.partition(score[seen], len(seen) - k)[len(seen) - k]
                seen, missing = seen[score[seen] >= least], missing[score[seen] >= least]
            by = np.lexsort([ids[seen], -score[seen]])[:k]
            yield item, row["shard"], ids[seen[by]], score[seen[by]], missing[by] == 0, most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.int32()), ("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64())), ("exact", pa.list_(pa.bool_())), ("most", pa.int64())])
        with shared.worker("lexical"):
            for batch in batches:
                for i in range(len(batch)):
                    mine = batch.column("items")[i].as_py()
                    found = list(search({"shard": batch.column("shard")[i].as_py()}, batch, i, list(range(len(coded))) if mine is None else mine))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), kind.type) for c, kind in zip(zip(*found, strict=True), schema, strict=True)] if found else [pa.array([], kind.type) for kind in schema], schema=schema)

    return shards.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score): the k best of what the shards found; each task passes on only k of an item."""
    rows = found.select("item", F.explode(F.arrays_zip("ids", "scores", "exact")).alias("x")).select("item", F.nullif("x.ids", F.lit(int(_NULL))).alias("doc_id"), F.col("x.scores").alias("score"), "x.exact")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(spark: SparkSession, tmp: shared.Scratch, index: Index, items: list[tuple[list[str], list[int]]], k: int) -> DataFrame:
    """(item, rank, doc_id, score) for items by number. Pairs of item and shard fall from tier to tier until no document of
    the shard that isn't exact yet can reach the item's k-th best score."""
    settled, pending, stages = None, None, len(TIERS) + 1
    for tier in range(stages):
        shards = spark.read.parquet(f"{index.path}/shards").select("shard", "ids", "terms", *_COLUMNS[: len(_PARTS) * (tier + 1)])
        if pending is None:
            shards = shards.withColumn("items", F.lit(None).cast("array<int>"))
        else:
            shards = shards.join(shared.small(pending, width=16 + 4 * len(items)), "shard")
        found = tmp.cut(_scored(shards, items, tier, k), f"tier{tier}")
        known = found if settled is None else settled.unionByName(found)
        if tier == stages - 1:
            settled = known
            break
        least = _best(known, k).groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0).alias("least"))
        least = shared.small(tmp.cut(_few(least), "least"), len(items))
        judged = found.join(least, "item", "left").withColumn("open", (F.col("most") > 0) & (F.col("most") >= F.coalesce("least", F.lit(0))))
        proved = judged.where(~F.col("open")).drop("least", "open")
        settled = tmp.cut(_few(proved if settled is None else settled.unionByName(proved)), "proved")
        pending = tmp.cut(_few(judged.where("open").groupBy("shard").agg(F.collect_list("item").alias("items"))), "pending")
        if pending.isEmpty():
            break
    # a document that isn't exact in a settled pair can't reach the k-th best score
    exact = settled.withColumn("x", F.filter(F.arrays_zip("ids", "scores", "exact"), lambda x: x["exact"]))
    exact = exact.select("item", F.col("x.ids").alias("ids"), F.col("x.scores").alias("scores"), F.col("x.exact").alias("exact"))
    return _best(exact, k).select("item", "rank", "doc_id", "score")


def search(spark: SparkSession, index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score of each item, those with score 0 left out, ties to
    the smaller doc_id. The index must hold the items' terms.

    Scores are whole numbers and the same as an exhaustive sum gives. Items are searched in blocks of about ITEM_BYTES, so what
    is sent to the tasks is bounded; each block reads the index once. Defined results: an item without a known term, or a null
    text, has no rows; rows with one item_id are one item with the terms of all; a null item_id has no rows; a null doc_id
    comes before others at equal scores; rows with one doc_id are documents of their own.
    """
    tmp = shared.Scratch(spark, "lexical")
    weights = tmp.cut(_few(weighted(spark, index, item_terms(items, id_col, text_col))), "weights")
    size = weights.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    made = None
    for block in range(blocks):
        mine = weights.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("x"))
        rows = mine.select("item_id", "x.term", "x.w").collect()
        found = _search(spark, tmp, index, [(r.term, r.w) for r in rows], k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {dict(weights.dtypes)['item_id']}")
        part = found.join(shared.small(names, len(rows), 48), "item").select("item_id", "rank", "doc_id", "score")
        part = part if blocks == 1 else tmp.cut(part, "block")
        made = part if made is None else made.unionByName(part)
    return made


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    lower = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.explode(F.split(lower, GAP)).alias("term"))
    return rows.where("term <> ''").distinct()


def top_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """search() over an index that is built for these items."""
    index = build(spark, docs, shared.Scratch(spark, "tiers").path("index"), item_terms(items))
    return search(spark, index, items, k)
