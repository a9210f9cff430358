"""Nearest neighbours by robust-pruned graphs, and near-duplicate vectors by small-world graphs, in shards.

Vectors are dealt to shards by a hash, so shards are even; equal vectors come to one shard and are one node. A shard's
graph is built once and written as one row. Nearest neighbours: queries are dealt to (shard, block of queries). Links:
the vectors of each shard query its own graph and those of all later shards, so each pair of shards meets once, and what
is found counts for both ends. A task holds one shard's graph and one block or shard of queries. Vectors of different
lengths are never compared.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import graphs, shared

#: Shards at least, so that small tables use several machines too: for nearest neighbours, whose few queries make many
#: shards cheap and their builds even, and for links, where all vectors query half of all shards.
NEAREST_SHARDS, LINK_SHARDS = 12, 6
#: Distinct vectors that a shard holds at most, about, and bytes of their components; queries that a block holds, about.
SHARD_ROWS, SHARD_BYTES, BLOCK = 131_072, 64 << 20, 32_768
#: Out-degree, beam of the builder, and relaxation of the pruned graph.
DEGREE, BUILD_WIDTH, ALPHA = 32, 64, 1.2
#: Each task audits its beam: over so many of its queries and, for links, as many planted ones, so much of what a comparison
#: with the whole shard finds must be found, or the beam is doubled. First beams of nearest neighbours and of links.
AUDIT_QUERIES, NEAREST_RECALL, LINK_RECALL, NEAREST_WIDTH, LINK_WIDTH = 128, 0.99, 0.999, 32, 16
#: Components of vectors that are compared in double precision at a time.
TOGETHER = 4_000_000


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, dim): rows whose vector isn't null, zero or empty and has no null or non-finite component."""
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, the same for (a, b) and (b, a)."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    with np.errstate(all="ignore"):
        plain = (a * b).sum(axis=1) / norms
    odd = ~np.isfinite(plain) | (norms < 1e-280)
    if odd.any():  # squares that overflow or vanish: scale first
        x, y = a[odd] / np.abs(a[odd]).max(axis=1, keepdims=True), b[odd] / np.abs(b[odd]).max(axis=1, keepdims=True)
        plain[odd] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    return np.clip(plain, -1.0, 1.0)


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _index(group: pa.Table, blob: bytes) -> pa.Table:
    return pa.table({"dim": group.column("dim")[:1].cast(pa.int32()), "shard": group.column("shard")[:1].cast(pa.int64()), "blob": pa.array([blob], pa.binary())})


_INDEX = "dim int, shard long, blob binary"


def _shards(rows: int, dim: int | None, least: int) -> int:
    """How many shards hold so many vectors of so many components."""
    return max(least, math.ceil(rows / max(1, min(SHARD_ROWS, SHARD_BYTES // (4 * max(dim or 1, 1))))))


def _shard(n: int) -> F.Column:
    return F.pmod(F.xxhash64("v"), F.lit(n))


def _distinct(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of v that stand for the distinct ones, and for each row the place of its own."""
    keys = np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel()
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return first, inverse.ravel()


def _dealt(queries: DataFrame, shards: int, blocks: int) -> DataFrame:
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
    return queries.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))


def _with_blocks(index: DataFrame, blocks: int) -> DataFrame:
    return index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))


def nearest(spark: SparkSession, vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, the k rows of largest cosine that the
    pruned graphs find among all others, nearest first, ties to the smaller id.

    Each shard's graph: greedy beam searches propose neighbours, robust pruning with relaxation ALPHA keeps diverse
    edges (one round with 1, one with ALPHA), and nodes that a search misses get an edge. Queries beam-search every
    shard, with a beam that an audit of each task widens until it finds NEAREST_RECALL of the k + 1 nearest of the shard;
    all that single precision can't tell from these are scored again on the original vectors in double precision. Vectors of
    one direction are one node, whatever their lengths; each is scored by itself. Defined results: unusable vectors and
    null ids take no part, as query or candidate; rows repeated with id and vector count once; of equal vectors the k + 1
    smallest ids are kept, which is all that can come up; with fewer than k candidates all are given; an empty table
    gives an empty result; other columns are ignored.
    """
    tmp = shared.Scratch(spark, "nearest")
    clean = tmp.cut(usable(vectors, id_col, vec_col).dropDuplicates(["id", "v"]), "vectors")
    first = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    nodes = clean.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).drop("nth")
    total, dim = clean.agg(F.count("*"), F.max("dim")).first()
    shards = _shards(total, dim, NEAREST_SHARDS)

    def build(group: pa.Table) -> pa.Table:
        v, ids = _matrix(group.column("v")), group.column("id").to_numpy()
        use = _least_ids(v, ids, k + 1)
        v, ids = v[use], ids[use]
        x = _unit(v)
        rep, place = _distinct(x)  # one node for each direction, as single precision tells them apart
        x = x[rep]
        graph, entry = graphs.build(x, DEGREE, BUILD_WIDTH, ALPHA, rounds=(1.0, ALPHA))
        visits = graphs.Visits(len(x))
        graph = graphs.repair(x, graph, lambda g, y: graphs.beam_search(x, g, y, np.full((len(y), 1), entry), BUILD_WIDTH // 2, visits=visits)[0])
        return _index(group, _dump(v=v, ids=ids, rep=rep, place=place, graph=graph.astype(np.int32), entry=np.array(entry)))

    index = tmp.cut(nodes.withColumn("shard", _shard(shards)).groupBy("dim", "shard").applyInArrow(build, _INDEX), "index")
    queries = clean.where(F.pmod("id", F.lit(every)) == 0)
    blocks = max(1, math.ceil(queries.count() / BLOCK))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "query_hash": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            at = np.load(io.BytesIO(left.column("blob")[0].as_py()))
            v, ids, rep, place, graph, entry = (at[n] for n in ("v", "ids", "rep", "place", "graph", "entry"))
            x, q, qid, qhash = _unit(v[rep]), _matrix(right.column("v")), right.column("id").to_numpy(), right.column("hash").to_numpy()
            order = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[order], np.arange(len(x) + 1))
            visits = graphs.Visits(len(x))
            beam = lambda y, width: graphs.beam_search(x, graph, y, np.full((len(y), 1), int(entry)), width, visits=visits)
            width = _audited(x, _unit(q[np.random.default_rng(0).permutation(len(q))[:AUDIT_QUERIES]]), k + 1, beam)
            for lo in range(0, len(q), graphs.TOGETHER):
                part = q[lo : lo + graphs.TOGETHER]
                for row, node in _close(_unit(part), beam, width, k + 1, len(x)):
                    # one row for each vector of each node found
                    n = starts[node + 1] - starts[node]
                    pick = order[np.repeat(starts[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    row = np.repeat(row, n)
                    use = ids[pick] != qid[lo + row]
                    row, pick = row[use], pick[use]
                    step = max(1, TOGETHER // v.shape[1])
                    score = np.concatenate([np.zeros(0), *(cosine(part[row[i : i + step]], v[pick[i : i + step]]) for i in range(0, len(row), step))])
                    other = ids[pick]
                    by = np.lexsort([other, -score, row])
                    row, score, other = row[by], score[by], other[by]
                    top = np.arange(len(row)) - np.searchsorted(row, row) < k
                    for name, value in (("query_id", qid[lo + row[top]]), ("query_hash", qhash[lo + row[top]]), ("vec_id", other[top]), ("score", score[top])):
                        out[name].append(value)
        return pa.table({n: pa.array(np.concatenate(v) if v else [], pa.float64() if n == "score" else pa.int64()) for n, v in out.items()})

    dealt = _dealt(queries.withColumn("hash", F.xxhash64("v")), shards, blocks)
    found = _with_blocks(index, blocks).groupBy("dim", "shard", "block").cogroup(dealt.groupBy("dim", "shard", "block"))
    found = found.applyInArrow(search, "query_id long, query_hash long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _least_ids(v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that can come up: of vectors that differ by a power of two only, which have the same cosine with any other to the
    last bit, those of the k smallest ids."""
    with np.errstate(all="ignore"):
        scaled = np.ldexp(v.astype(np.float64), -np.frexp(np.abs(v).max(axis=1).astype(np.float64))[1][:, None])
    _, group = _distinct(scaled)
    by = np.lexsort([ids, group])
    nth = np.arange(len(by)) - np.searchsorted(group[by], group[by])
    return np.sort(by[nth < k])


def _close(queries: np.ndarray, beam: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]], width: int, k: int, nodes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of what may be among the k nearest: all whose single-precision score is within its rounding of the k-th
    best. Queries whose whole beam is as near as that are searched again with twice the beam."""
    todo, slack = np.arange(len(queries)), 2e-7 * (queries.shape[1] + 16)
    while len(todo):
        found, near = beam(queries[todo], width)
        least = near[:, min(k, near.shape[1]) - 1] - slack
        full = (near[:, -1] >= least) & (found[:, -1] >= 0) & (width < nodes)
        row, col = np.nonzero((found >= 0) & (near >= least[:, None]) & ~full[:, None])
        if len(row):
            yield todo[row], found[row, col]
        todo, width = todo[full], 2 * width


def _audited(x: np.ndarray, audit: np.ndarray, k: int, beam: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> int:
    """The beam, doubled from NEAREST_WIDTH, with which the audit's queries find enough of their k nearest nodes."""
    width = max(NEAREST_WIDTH, 4 * k)
    scores = audit @ x.T
    least = np.partition(scores, max(len(x) - k, 0), axis=1)[:, max(len(x) - k, 0)] - 1e-6
    while width < len(x):
        found = sum(int((beam(audit[lo : lo + graphs.TOGETHER], width)[1][:, :k] >= least[lo : lo + graphs.TOGETHER, None]).sum()) for lo in range(0, len(audit), graphs.TOGETHER))
        if found >= NEAREST_RECALL * len(audit) * min(k, len(x)):
            break
        width *= 2
    return width


def _linked(x: np.ndarray, q: np.ndarray, part: np.ndarray, y: np.ndarray, v: np.ndarray, cols: np.ndarray, least: float) -> np.ndarray:
    """Which of the vectors q[part] and v[cols] have a cosine of least or more. x and y are their unit vectors in single
    precision; what that can't decide is decided in double precision."""
    score = x[part] @ y[cols].T
    slack = 2e-7 * (x.shape[1] + 16)
    linked = score >= least + slack
    r, c = np.nonzero((score >= least - slack) & ~linked)
    step = max(1, TOGETHER // x.shape[1])
    for lo in range(0, len(r), step):
        i, j = r[lo : lo + step], c[lo : lo + step]
        linked[i, j] = cosine(q[part[i]], v[cols[j]]) >= least
    return linked


def _planted(x: np.ndarray, least: float, count: int) -> np.ndarray:
    """Unit vectors with a cosine from least to 1 to a node, so that there is something to be found whatever the table."""
    rng = np.random.default_rng(1)
    of = x[rng.integers(0, len(x), count)].astype(np.float64)
    away = rng.normal(size=of.shape)
    away -= (away * of).sum(axis=1, keepdims=True) * of
    away /= np.maximum(np.sqrt((away * away).sum(axis=1, keepdims=True)), 1e-30)
    c = rng.uniform(least + 0.001, 1.0, (count, 1))
    return _unit(c * of + np.sqrt(1 - c * c) * away)


def _link_width(world: graphs.SmallWorld, x: np.ndarray, least: float, own: bool) -> int:
    """The beam, doubled from LINK_WIDTH, with which audit queries find enough of their links in the shard. A vector of
    the shard finds itself; that counts as no link."""
    audit = np.concatenate([x[np.random.default_rng(0).permutation(len(x))[:AUDIT_QUERIES]], _planted(world.x, least, AUDIT_QUERIES)])
    mine = min(AUDIT_QUERIES, len(x)) if own else 0
    want, width = int((audit @ world.x.T >= least).sum()) - mine, LINK_WIDTH
    while width < len(world.x):
        found = sum(int((audit[part] @ world.x[group].T >= least).sum()) for part, group in world.near_ones(audit, least, width)) - mine
        if found >= LINK_RECALL * want:
            break
        width *= 2
    return width


def near_duplicates(spark: SparkSession, vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors are linked if their cosine in double precision is least or more. Each shard has a hierarchical small-world
    graph; every vector queries its own shard's and all later ones, so all pairs of shards are searched. For each task an
    audit compares the links that the graph finds for some of its queries, and for planted ones, with all there are in
    the shard, and the beam is doubled until LINK_RECALL is met. n_links counts the other vectors linked directly;
    component_id is the smallest id reachable; kept says whether that is the row's own. Defined results: unusable vectors
    link with nothing; equal vectors are one node, whose copies link with each other; rows with one id and vector count
    once; of one id's different vectors each has its own n_links, but they share their component; a null id gets a null
    component_id and is kept; an empty table gives an empty result; other columns are ignored. Tasks give counts and a
    spanning forest of their links and never hold all pairs.
    """
    tmp = shared.Scratch(spark, "vector-links")
    clean = usable(vectors, id_col, vec_col)
    reps = clean.groupBy("v", "id").agg(F.lit(1).alias("one")).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    reps = tmp.cut(reps.withColumns({"dim": F.size("v"), "node": F.monotonically_increasing_id()}), "distinct")
    total, dim = reps.agg(F.count("*"), F.max("dim")).first()
    shards = _shards(total, dim, LINK_SHARDS)

    def build(group: pa.Table) -> pa.Table:
        v = _matrix(group.column("v"))
        world = graphs.SmallWorld(_unit(v)).build()
        levels = {f"{part}{i}": value for i, level in enumerate(world.levels) for part, value in zip("agn", (level[0].astype(np.int32), level[1].astype(np.int32), np.array(level[2])), strict=True)}
        return _index(group, _dump(v=v, **{c: group.column(c).to_numpy() for c in ("node", "id", "n")}, **levels))

    placed = reps.withColumn("shard", _shard(shards))
    index = tmp.cut(placed.groupBy("dim", "shard").applyInArrow(build, _INDEX), "index")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        node, count, a, b = (np.zeros(0, np.int64) for _ in range(4))
        if left.num_rows and right.num_rows:
            own = key[1].as_py() == key[2].as_py()
            at = np.load(io.BytesIO(left.column("blob")[0].as_py()))
            v, world = at["v"], graphs.SmallWorld(_unit(at["v"]))
            world.levels = [(at[f"a{i}"].astype(np.int64), at[f"g{i}"], int(at[f"n{i}"])) for i in range(sum(k[0] == "g" for k in at.files))]
            q, mine, theirs = _matrix(right.column("v")), {c: right.column(c).to_numpy() for c in ("node", "id", "n")}, {c: at[c] for c in ("node", "id", "n")}
            x, of_q, of_v, joined, waiting = _unit(q), np.zeros(len(q)), np.zeros(len(v)), [], 0
            for part, group in world.near_ones(x, least - 1e-3, _link_width(world, x, least, own)):
                for lo in range(0, len(group), graphs.CHUNK):
                    cols = group[lo : lo + graphs.CHUNK]
                    linked = _linked(x, q, part, world.x, v, cols, least)
                    if own:
                        linked &= mine["node"][part][:, None] != theirs["node"][cols][None, :]
                    weight = linked.astype(np.float64)
                    of_q[part] += weight @ theirs["n"][cols]
                    if not own:
                        of_v[cols] += mine["n"][part] @ weight
                    i, j = graphs.linked_groups(linked)
                    joined.append((mine["id"][part[i]], theirs["id"][cols[j]]))
                    waiting += len(i)
                    if waiting > 1_000_000:
                        joined, waiting = [graphs.forest(*map(np.concatenate, zip(*joined, strict=True)))], 0
            if joined:
                a, b = graphs.forest(*map(np.concatenate, zip(*joined, strict=True)))
            node, count = np.concatenate([mine["node"], theirs["node"]]), np.concatenate([of_q, of_v]).astype(np.int64)
            node, count = node[count > 0], count[count > 0]
        none = lambda m: pa.nulls(m, pa.int64())
        both = lambda x, y: pa.chunked_array([x, y])
        k, m = len(node), len(a)
        return pa.table({"node": both(pa.array(node), none(m)), "links": both(pa.array(count), none(m)), "a": both(none(k), pa.array(a)), "b": both(none(k), pa.array(b))})

    upto = lambda lo, hi: F.explode(F.sequence(F.lit(lo).cast("long") if isinstance(lo, int) else lo, F.lit(hi).cast("long") if isinstance(hi, int) else hi))
    queries = placed.withColumnRenamed("shard", "i").withColumn("j", upto(F.col("i"), shards - 1)).groupBy("dim", "i", "j")
    graph = index.withColumnRenamed("shard", "j").withColumn("i", upto(0, F.col("j"))).groupBy("dim", "i", "j")
    found = tmp.cut(graph.cogroup(queries).applyInArrow(search, "node long, links long, a long, b long"), "links")

    # ids that have several vectors join the components of all of them
    several = clean.groupBy("id").agg(F.min(F.xxhash64("v")).alias("lo"), F.max(F.xxhash64("v")).alias("hi")).where("lo <> hi").select(F.col("id").alias("a"))
    several = tmp.cut(several, "several")
    edges = found.where("a is not null").select("a", "b")
    if not several.isEmpty():
        of = clean.select(F.col("id").alias("a"), "v").distinct().join(shared.small(several), "a")
        edges = edges.unionAll(of.join(reps.select("v", F.col("id").alias("b")), "v").select("a", "b"))
    labels = shared.components(tmp, edges).select(F.col("node").alias("id"), "component")
    counts = tmp.cut(found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links")), "counts")
    judged = reps.join(shared.small(counts), "node", "left").join(shared.small(labels), "id", "left")
    judged = judged.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    judged = shared.small(tmp.cut(judged, "judged"), total, 8 * (dim or 1) + 32)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).withColumn("v", F.when(F.col("vec_id").isNotNull(), F.col("v")))
    out = rows.join(judged, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
