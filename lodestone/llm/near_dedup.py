"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, shingles

#: Signature coordinates are BANDS x ROWS. At a Jaccard similarity of 0.85 all bands miss with probability 2.6e-4.
BANDS, ROWS = 26, 8
#: At lower similarities as many rows as COORDINATES allow, and bands enough that a pair at the threshold is missed with at most MISS.
COORDINATES, MISS = 256, 2.6e-4
#: A candidate group of more documents or shingles is cut into blocks of about so many documents and at most about so many shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 64, 1_000_000
#: The size class of ids that have texts of several sizes; sizes of other classes that differ by more than one make no link.
ANY_SIZE = -1
#: Stands for no part, where ids of documents name the others.
NO_PART = -(1 << 63)
#: Columns of the dense 0/1 matrices that count intersections.
COLUMNS = 8192

_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("keys", pa.list_(pa.int64()))])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows for links of percent or more: BANDS x ROWS from 85, more bands of fewer rows below."""
    if percent >= 85:
        return BANDS, ROWS
    share = max(percent, 1) / 100
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log(1 - share**rows))
        if bands * rows <= COORDINATES:
            break
    return bands, rows


def _sketches(bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shared.worker("shingles", shingles.free):
            for batch in batches:
                for at in range(0, len(batch), 1000):
                    part = batch.slice(at, 1000)
                    n, fps, keys = [], [], []
                    for text in part.column("text"):
                        s = shingles.shingle_set(text.as_py())
                        n.append(len(s))
                        fps.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                        keys.append(shingles.band_keys(shingles.signature(s, bands * rows), bands) if len(s) else None)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=_SKETCH)

    return sketches


def _sets_of(*names: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, the named columns, and the texts' shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shared.worker("shingles", shingles.free):
            for batch in batches:
                for at in range(0, len(batch), 500):
                    part = batch.slice(at, 500)
                    sets = [shingles.shingle_set(t.as_py()).tobytes() for t in part.column("text")]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *names)), pa.array(sets, pa.binary())], names=["doc_id", *names, "shingles"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the shingles that two sets at least share."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    use = count[col] > 1
    rows, col = rows[use], new[col[use]]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    inter = np.zeros((len(sets), len(sets)), np.int64)
    for c in range(0, int(new[-1]) + 1 if len(new) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, [c, c + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[rows[lo:hi], col[lo:hi] - c] = 1
        inter += np.rint(x @ x.T).astype(np.int64)
    np.fill_diagonal(inter, [len(s) for s in sets])
    return inter


def _verify(percent: int):
    def verify(group: pa.Table) -> pa.Table:
        """A star forest of the links that documents have with each other, or, if there are two sides, with the other's."""
        ids = group.column("doc_id").to_numpy()
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in group.column("shingles")]
        side = group.column("side").to_numpy()
        n = np.array([len(s) for s in sets], np.int64)
        inter = intersections(sets)
        linked = 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
        if side.min() != side.max():
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, True)
        label = ids.copy()
        while True:
            new = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
            if (new == label).all():
                break
            label = new
        away = label != ids
        return pa.Table.from_arrays([pa.array(label[away]), pa.array(ids[away])], schema=_LINKS)

    return verify


def _blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, part, head, size_class, n_shingles) with block: those of one part, head and size class, by a hash of their ids,
    about BLOCK_DOCS documents and BLOCK_SHINGLES shingles to a block."""
    by = ["part", "head", "size_class"]
    salts = docs.groupBy(by).agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_DOCS)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).alias("salts"))
    return docs.join(salts, by).withColumn("block", F.xxhash64(*by, F.pmod(F.xxhash64("doc_id"), "salts"))).drop("salts")


def dealt(tmp: shared.Scratch, keys: DataFrame, percent: int) -> DataFrame:
    """(doc_id, part, head, size_class, n_shingles, block): blocks of documents that are likely to be alike, from keys (doc_id, key,
    n_shingles), the buckets of large candidate groups. A document's head is, of all that share a bucket with it, the
    one that meets most others, as the original of many copies does; where few have that head, it is the head's own.
    Documents of one head and of sizes that may be linked form blocks."""
    met = keys.groupBy("key").agg(F.count("*").alias("met"))
    often = keys.join(met, "key").groupBy("doc_id").agg(F.sum("met").alias("often"))
    ranked = keys.join(often, "doc_id").select("doc_id", "key", F.struct("often", (-F.col("doc_id")).alias("id")).alias("rank"))
    tops = ranked.groupBy("key").agg(F.max("rank").alias("rank"))
    n = F.col("n_shingles")
    heads = keys.join(tops, "key").groupBy("doc_id").agg(F.max(n).alias("n_shingles"), (F.min(n) < F.max(n)).alias("several"), (-F.max("rank")["id"]).alias("head"))
    step = math.log(100 / min(max(percent, 1), 99)) * (1 + 1e-9)
    size_class = F.when(F.col("several"), ANY_SIZE).otherwise(F.floor(F.log(n.cast("double")) / step)).cast("long")
    heads = tmp.cut(heads.select("doc_id", F.lit(NO_PART).alias("part"), "head", size_class.alias("size_class"), "n_shingles"), "heads")
    for _ in range(2):
        up = heads.select(F.col("doc_id").alias("head"), F.col("head").alias("up"))
        held = heads.groupBy("head").agg(F.count("*").alias("held")).join(up, "head")
        above = F.when(F.col("held") < BLOCK_DOCS, F.col("up")).otherwise(F.col("head"))
        heads = heads.join(held, "head").select("doc_id", "part", above.alias("head"), "size_class", "n_shingles")
    return tmp.cut(_blocks(heads), "placed")


def crossing(tmp: shared.Scratch, keys: DataFrame, placed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is to be compared once documents have labels (node, component) from the links within their blocks. The documents
    are dealt to blocks again, those of a label that many have apart from the rest: pairs of blocks (i, j), or one block with itself,
    that share a bucket, and the documents (doc_id, block) of such buckets. Left out are buckets and pairs of blocks
    whose documents are all linked already, and pairs whose sizes differ too much."""
    named = placed.drop("block").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
    named = tmp.cut(named.drop("component"), "labelled")
    many = named.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK_DOCS).select("label", F.col("label").alias("many"))
    blocks = _blocks(named.join(many, "label", "left").withColumn("part", F.coalesce("many", "part")).drop("many"))
    named = keys.select("doc_id", "key").distinct().join(blocks.select("doc_id", "size_class", "block", "label"), "doc_id")
    named = tmp.cut(named, "named")
    open_ = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    named = tmp.cut(named.join(open_, "key", "left_semi"), "unsettled")
    sides = named.groupBy("key", "size_class", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    left, right = (sides.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("size_class", "block", "lo", "hi"))) for k in "ij")
    alike = (F.abs(F.col("size_class_i") - F.col("size_class_j")) <= 1) | (F.least("size_class_i", "size_class_j") == ANY_SIZE)
    settled = (F.col("lo_i") == F.col("hi_i")) & (F.col("lo_i") == F.col("lo_j")) & (F.col("lo_j") == F.col("hi_j"))
    pairs = left.join(right, "key").where((F.col("block_i") <= F.col("block_j")) & alike & ~settled)
    pairs = tmp.cut(pairs.select(F.col("block_i").alias("i"), F.col("block_j").alias("j")).distinct(), "pairs")
    return pairs, named.select("doc_id", "block").distinct()


def _large_links(tmp: shared.Scratch, keys: DataFrame, docs: DataFrame, percent: int) -> list[DataFrame]:
    """Links (a, b) of large candidate groups, given by their buckets (doc_id, key, n_shingles). Blocks are compared with
    themselves and their heads; what that leaves open is compared by pairs of blocks that share a bucket."""
    placed = dealt(tmp, keys, percent)
    texts = docs.join(shared.small(placed.select("doc_id")), "doc_id")
    sets = tmp.cut(texts.mapInArrow(_sets_of(), "doc_id long, shingles binary"), "sets")
    here = F.lit(0).cast("long").alias("side")
    own = placed.select("doc_id", "block").unionAll(placed.select(F.col("head").alias("doc_id"), "block")).distinct()
    own = sets.join(own, "doc_id").select("doc_id", F.col("block").alias("of"), here, "shingles")
    links = tmp.cut(own.groupBy("of").applyInArrow(_verify(percent), "a long, b long"), "links-within")
    pairs, members = crossing(tmp, keys, placed, shared.components(tmp, links))
    members = sets.join(members, "doc_id")
    pairs = pairs.withColumn("of", F.xxhash64("i", "j"))
    sides = pairs.select("of", F.col("i").alias("block"), here).unionAll(pairs.where("i < j").select("of", F.col("j").alias("block"), F.lit(1).cast("long")))
    both = members.join(sides, "block").select("doc_id", "of", "side", "shingles")
    return [links, tmp.cut(both.groupBy("of").applyInArrow(_verify(percent), "a long, b long"), "links-across")]


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the smallest
    doc_id reachable by links, kept says whether that is the document itself. Candidates come from circulant MinHash
    bands; every link is confirmed on full sets. Defined results: null, empty or blank texts have no shingles and link
    with nothing; rows with one doc_id count as one node, which has the links of all of them; a row with a null doc_id
    takes no part, has a null component_id and is kept; an empty table gives an empty result; other columns are ignored,
    whatever their names.

    Exact copies are folded to one document first. Candidate groups are the components of "shares a band", found on
    ids alone. A group of at most BLOCK_DOCS documents is compared in one task, so each set travels once. The documents
    of larger groups are dealt to blocks of likely copies; each block is compared with itself and its head, and of the
    rest only blocks that share a band and aren't linked yet, pair by pair. No task holds more than two blocks. Tasks
    return a spanning forest of the links they find, never all pairs.
    """
    tmp = shared.Scratch(spark, "near-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = tmp.cut(docs.mapInArrow(_sketches(*banding(percent)), "doc_id long, n_shingles long, fp binary, keys array<long>"), "sketch")
    ids = sketch.select("doc_id", "n_shingles", "fp")

    copies = ids.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = tmp.cut(copies.select("fp", "rep"), "copies")
    n_copies = copies.count()
    folded = sketch.where("fp is not null and doc_id is not null").join(shared.small(copies, n_copies), "fp", "left").where("rep is null or rep = doc_id")
    keyed = folded.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    heads = tmp.cut(keyed.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("key", "head"), "heads")
    n_heads = heads.count()
    candidates = keyed.join(shared.small(heads, n_heads), "key").where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    groups = shared.components(tmp, candidates)

    sizes = ids.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    members = tmp.cut(groups.join(sizes, groups.node == sizes.doc_id).select("doc_id", F.col("component").alias("comp"), "n_shingles"), "members")
    size = members.groupBy("comp").agg(((F.count("*") > BLOCK_DOCS) | (F.sum("n_shingles") > BLOCK_SHINGLES)).alias("large"))
    members = tmp.cut(members.join(shared.small(tmp.cut(size, "sizes")), "comp").select("doc_id", "comp", "large"), "groups")
    texts = docs.join(shared.small(members.where("not large").select("doc_id", "comp")), "doc_id")
    sets = texts.mapInArrow(_sets_of("comp"), "doc_id long, comp long, shingles binary")
    sets = sets.select("doc_id", F.col("comp").alias("of"), F.lit(0).cast("long").alias("side"), "shingles")
    links = [sets.groupBy("of").applyInArrow(_verify(percent), "a long, b long")]
    large = members.where("large").select("doc_id")
    if not large.isEmpty():
        keys = keyed.join(shared.small(large), "doc_id", "left_semi").join(shared.small(heads.select("key"), n_heads), "key", "left_semi")
        links += _large_links(tmp, tmp.cut(keys.select("doc_id", "key", "n_shingles").distinct(), "large-keys"), docs, percent)
    # ids that have several texts join the groups of all of them
    several = ids.where("doc_id is not null and fp is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    several = tmp.cut(several, "several")
    if not several.isEmpty():
        links.append(ids.join(shared.small(several), "doc_id", "left_semi").join(copies, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    labels = shared.components(tmp, functools.reduce(DataFrame.unionAll, links))

    rep = ids.join(shared.small(copies, n_copies), "fp", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("node"))
    found = rep.join(shared.small(labels), "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all its columns, without the documents that near_duplicates() does not keep; of rows that repeat a
    doc_id and its text, the first by their columns as JSON stays. Rows with a null doc_id stay."""
    tmp = shared.Scratch(spark, "keep-one")
    out = tmp.cut(near_duplicates(spark, docs, percent, id_col, text_col).where("doc_id is not null").select("doc_id", "kept"), "kept")
    gone = out.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    gone = tmp.cut(gone.where("not kept or n > 1").select(F.col("doc_id").alias("__id"), F.col("kept").alias("__kept")), "gone")
    lost = docs.join(shared.small(gone.where("not __kept")), F.col(id_col) == F.col("__id"), "left_anti")
    twice = gone.where("__kept").select("__id")
    if twice.isEmpty():
        return lost
    once = lost.join(twice, F.col(id_col) == F.col("__id"), "left_anti")
    again = lost.join(twice, F.col(id_col) == F.col("__id"), "left_semi")
    nth = F.row_number().over(Window.partitionBy(id_col, text_col).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))))
    again = again.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
    return once.unionByName(again)
