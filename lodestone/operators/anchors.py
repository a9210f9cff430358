"""Which texts stand in which longer ones of their group, by anchors: rolling hashes that a text shares with all that hold it.

Every stretch of Q characters has a hash; of each W neighbouring ones the smallest is an anchor. The choice depends on the
stretch alone, so the anchors of a text are among those of every text that holds it. A text probes the index of its group's
anchors with its rarest one only, and what it finds is confirmed. Texts too short for an anchor go by hashes of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lineage

#: Characters of a hash and hashes of a window; a text of FULL characters has an anchor. W is a power of two.
Q, W = 8, 8
FULL = Q + W - 1
#: Characters of the texts that a task matches at a time, about. A group of more is dealt to several tasks by its anchors.
PART_CHARS = 1 << 20
#: Characters of a short text by which the places where it may begin are found first.
_LEAD = 4
#: Bits of a hash by which values are sorted out before they are looked up.
_BITS = 16
#: Characters of the groups, about, whose texts are hashed at a time.
_NEAR_CHARS = 1 << 17
#: Pairs that are confirmed at a time.
_TOGETHER = 1 << 20

_P, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    return x ^ (x >> np.uint64(29))


def _likely(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values may be among the wanted, by some bits of each: true for all that are."""
    bits = np.zeros(1 << _BITS, bool)
    bits[(wanted & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return bits[(values & np.uint64(len(bits) - 1)).astype(np.int64)]


class Rolling:
    """Hashes of all stretches of a list of texts, modulo 2^64: sums of characters times powers, the first power taken out."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        powers = np.cumprod(np.full(len(codes), _P, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * powers)])
        self.back = np.cumprod(np.full(len(codes), pow(_P, -1, 1 << 64), np.uint64))

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the size characters from each place on, and whether they are of one text."""
        n = max(0, len(self.text) - size + 1)
        return _mixed((self.sums[size : size + n] - self.sums[:n]) * self.back[:n]), self.text[:n] == self.text[size - 1 : size - 1 + n]

    def at(self, places: np.ndarray, size: int) -> np.ndarray:
        """hashes() at some places only."""
        return _mixed((self.sums[places + size] - self.sums[places]) * self.back[places])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, anchor), in order of texts; neighbouring windows with one anchor give it once."""
        least, _ = self.hashes(Q)
        step = 1
        while step < W:
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            step *= 2
        own = self.text[: len(least)]
        whole = own == self.text[FULL - 1 : FULL - 1 + len(least)] if len(least) else np.zeros(0, bool)
        new = np.append(True, (least[1:] != least[:-1]) | (own[1:] != own[:-1]) | ~whole[:-1])[: len(least)]
        return own[whole & new].astype(np.int64), least[whole & new]


def contained(texts: list[str], group: np.ndarray, needle: np.ndarray, hay: np.ndarray, short_hay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of places, each once: the needle texts[a], not empty, stands in the longer text b of its group. b is one
    of hay, or for needles of fewer than FULL characters one of short_hay. Texts of a group are different. Where groups stand
    in order, some are taken at a time, so that what is made of their texts stays near the processor."""
    if not len(texts) or (group[1:] < group[:-1]).any():
        return _contained(texts, group, needle, hay, short_hay)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    nth = (ends - 1)[starts] // _NEAR_CHARS
    cuts = [*starts[np.append(True, nth[1:] != nth[:-1])].tolist(), len(texts)]
    found = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        a, b = _contained(texts[lo:hi], group[lo:hi], needle[lo:hi], hay[lo:hi], short_hay[lo:hi])
        found.append((a + lo, b + lo))
    a, b = zip(*found, strict=True)
    return np.concatenate(a), np.concatenate(b)


def _contained(texts: list[str], group: np.ndarray, needle: np.ndarray, hay: np.ndarray, short_hay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    roll, found = Rolling(texts), [np.zeros((0, 2), np.int64)]
    salt = _mixed(group.astype(np.uint64) + np.uint64(1))

    def confirm(a: np.ndarray, b: np.ndarray) -> None:
        near = (roll.sizes[b] > roll.sizes[a]) & (group[a] == group[b])
        pairs = np.unique(a[near] * len(texts) + b[near])
        i, j = pairs // max(1, len(texts)), pairs % max(1, len(texts))
        holds = np.fromiter((texts[x] in texts[y] for x, y in zip(i.tolist(), j.tolist(), strict=True)), bool, len(pairs))
        found.append(np.stack([i[holds], j[holds]], axis=1))

    own, anchor = roll.anchors()
    anchor = anchor ^ salt[own]
    of_hay, asks = np.flatnonzero(hay[own]), np.flatnonzero(needle[own])
    of_hay = of_hay[np.argsort(anchor[of_hay])]
    held, holder = anchor[of_hay], own[of_hay]
    begin = np.flatnonzero(np.append(True, held[1:] != held[:-1])[: len(held)])  # of each run of equal anchors
    ranges = np.zeros((2, len(own)), np.int64)  # where an anchor stands in held; what stands there itself isn't looked up
    ranges[:, of_hay] = np.repeat(np.stack([begin, np.append(begin[1:], len(held))[: len(begin)]]), np.diff(np.append(begin, len(held))), axis=1)
    apart = np.flatnonzero(needle[own] & ~hay[own])
    ranges[:, apart] = np.searchsorted(held, anchor[apart], "left"), np.searchsorted(held, anchor[apart], "right")
    asking, (lo, hi) = own[asks], ranges[:, asks]
    if len(asking):
        first = np.flatnonzero(np.append(True, asking[1:] != asking[:-1]))
        rarest = np.minimum.reduceat(((hi - lo) << 32) | np.arange(len(asking)), first) & 0xFFFFFFFF
        a, lo, n = asking[rarest], lo[rarest], (hi - lo)[rarest]
        ends, at = np.cumsum(n), 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, "right")))
            m = n[at:to]
            pick = np.repeat(lo[at:to] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            confirm(np.repeat(a[at:to], m), holder[pick])
            at = to
    short = np.flatnonzero(needle & (roll.sizes < FULL) & (roll.sizes > 0))
    for lead in np.unique(np.minimum(roll.sizes[short], _LEAD)).tolist():
        asking = short[np.minimum(roll.sizes[short], _LEAD) == lead]
        every, whole = roll.hashes(lead)  # places where any of them may begin
        of = roll.text[: len(every)]
        begins = np.flatnonzero(_likely(every ^ salt[of], every[roll.ends[asking] - roll.sizes[asking]] ^ salt[asking]) & whole & short_hay[of])
        room = roll.ends[roll.text[begins]] - begins
        for size in np.unique(roll.sizes[asking]).tolist():
            a = asking[roll.sizes[asking] == size]
            wanted = roll.at(roll.ends[a] - size, size) ^ salt[a]
            order = np.argsort(wanted)
            a, wanted = a[order], wanted[order]
            at = begins[room >= size]
            of = roll.text[at]
            value = roll.at(at, size) ^ salt[of]
            near = _likely(value, wanted)
            of, value = of[near], value[near]
            lo = np.searchsorted(wanted, value, "left")
            n = np.searchsorted(wanted, value, "right") - lo
            pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            confirm(a[pick], np.repeat(of, n).astype(np.int64))
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


class Folded:
    """Rows (group, text) folded to different ones: texts, group, and of, the place of each row's own."""

    def __init__(self, text: pa.Array, group: np.ndarray):
        coded = text.dictionary_encode()
        size = max(1, len(coded.dictionary))
        keys, self.of = np.unique(group.astype(np.int64) * size + coded.indices.to_numpy(), return_inverse=True)
        self.group, self.texts = keys // size, coded.dictionary.take(pa.array(keys % size, pa.int64())).to_pylist()

    def any(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, flag, len(self.texts)) > 0

    def count(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, flag, len(self.texts)).astype(np.int64)


# --- over tables -----------------------------------------------------------------------------------------------------

_ROW = ["_by", "_side", "_no", "_text", "_needle"]
#: What a row of a whole group has besides: it is searched, where it is at home, in the group's only bucket.
_WHOLE = {"_hay": True, "_home": True, "_part": 0}


def _routed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """rows with _buckets, of groups too large for one task, as rows for each bucket of the group: a text goes to the buckets
    of all its anchors to be searched, and to that of its smallest to search; one without an anchor searches in all buckets and
    is searched for such in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roll = Rolling(batch.column("_text").to_pylist())
            buckets, size = batch.column("_buckets").to_numpy().astype(np.uint64), roll.sizes
            own, anchor = roll.anchors()
            home = np.zeros(len(batch), np.int64)
            if len(own):
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                home[own[first]] = (np.minimum.reduceat(anchor, first) % buckets[own[first]]).astype(np.int64)
            short = np.flatnonzero(size < FULL)
            home[short] = [hash_of(t, int(b)) for t, b in zip(batch.column("_text").take(pa.array(short)).to_pylist(), buckets[short], strict=True)]
            spread = np.concatenate([np.arange(int(b)) for b in buckets[short]]) if len(short) else np.zeros(0, np.int64)
            row = np.concatenate([own, np.repeat(short, buckets[short].astype(np.int64))])
            bucket = np.concatenate([(anchor % buckets[own]).astype(np.int64), spread])
            pairs = np.unique(np.stack([row, bucket]), axis=1)
            row, bucket = pairs[0], pairs[1]
            at_home, long = bucket == home[row], size[row] >= FULL
            part = batch.take(pa.array(row))
            needle = part.column("_needle").to_numpy(zero_copy_only=False) & (at_home | ~long)
            columns = [*(part.column(n) for n in _ROW[:-1]), *map(pa.array, (needle, at_home | long, at_home, bucket))]
            yield pa.RecordBatch.from_arrays(columns, names=[*_ROW, *_WHOLE])

    return rows.mapInArrow(run, f"_by {kinds['_by']}, _side int, _no {kinds['_no']}, _text string, _needle boolean, _hay boolean, _home boolean, _part long")


def hash_of(text: str, buckets: int) -> int:
    """A number below buckets that is the same in all Python processes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return int(_mixed(np.array([int((codes * np.arange(1, len(codes) + 1, dtype=np.uint64)).sum()) + len(text)], np.uint64))[0] % np.uint64(buckets))


def matched(spans: DataFrame, sentences: DataFrame, work, schema: str) -> tuple[DataFrame, bool]:
    """What work(rows) gives for parts of the table, of whole groups and buckets of large ones, some PART_CHARS in all; and
    whether any group was dealt to several. spans, sentences: (_by, _no, _text, _needle). work gets an Arrow table of _by, _side (0: span, 1:
    sentence), _no, _text, _needle, _hay and _home."""
    rows = spans.withColumn("_side", F.lit(0)).unionByName(sentences.withColumn("_side", F.lit(1)))
    rows = lineage.cut(rows.select(*_ROW))
    sizes = rows.groupBy("_by").agg(F.sum(F.length("_text")).alias("_chars"))
    total, most = sizes.agg(F.sum("_chars"), F.max("_chars")).first()
    parts, several = max(1, -(-(total or 0) // PART_CHARS)), (most or 0) > PART_CHARS
    if several:
        large = lineage.cut(sizes.where(F.col("_chars") > PART_CHARS).select(F.col("_by").alias("_large"), F.ceil(F.col("_chars") / PART_CHARS).alias("_buckets")))
        both = rows.join(F.broadcast(large) if lineage.small(large) else large, F.col("_by") == F.col("_large"), "left")
        whole = both.where("_buckets is null").select(*_ROW, *[F.lit(v).cast("long" if k == "_part" else "boolean").alias(k) for k, v in _WHOLE.items()])
        rows = _routed(both.where("_buckets is not null").drop("_large"), dict(rows.dtypes)).unionByName(whole)
        parts += large.agg(F.sum("_buckets")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if not several:  # constants need not be shuffled
                for name, value in _WHOLE.items():
                    table = table.append_column(name, pa.array(np.full(len(table), value)))
            yield from work(table).to_batches(max_chunksize=100_000)

    return rows.repartition(int(parts), "_by", *(["_part"] if several else [])).mapInArrow(run, schema), several


def held_by(items: DataFrame, item_id: str, item_text: str, docs: DataFrame, doc_id: str, doc_text: str) -> DataFrame:
    """(item_id, doc_id) for each item and document whose text holds the item's; an empty text is in all, a null one in none.

    An item has one key, its smallest anchor or, if it is too short for one, the hash of its characters. Documents give those
    of their own keys that items have: the items' keys go to the tasks if they are few, else documents' keys are joined with
    them. What shares a key is compared as text. No text is copied for each of its words."""
    spark = items.sparkSession
    mine = lineage.cut(items.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_held")).where("_held is not null").withColumn("_size", F.when(F.length("_held") < FULL, F.length("_held")).otherwise(0)))

    def keyed(texts: list[str], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, size, key) for all anchors, size 0, and all stretches of the sizes."""
        roll = Rolling(texts)
        own, anchor = roll.anchors()
        found = [(own, np.zeros(len(own), np.int64), anchor)]
        for size in sizes:
            every, whole = roll.hashes(size)
            at = np.flatnonzero(whole)
            found.append((roll.text[at].astype(np.int64), np.full(len(at), size), every[at]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("_size").to_numpy()
            text, size, key = keyed(batch.column("_held").to_pylist(), np.unique(sizes[sizes > 0]).tolist())
            use = size == sizes[text]
            text, key = text[use], key[use]
            order = np.lexsort([key, text])
            first = order[np.append(True, text[order][1:] != text[order][:-1])[: len(order)]]
            rows = batch.take(pa.array(text[first]))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(key[first].view(np.int64))], names=["_item", "_held", "_size", "_key"])

    kinds = dict(mine.dtypes)
    short = [r[0] for r in mine.select("_size").where("_size > 0").distinct().collect()]  # below FULL
    keys = lineage.cut(mine.where("_held <> ''").mapInArrow(of_items, f"_item {kinds['_item']}, _held string, _size int, _key long"))
    distinct = keys.select("_size", "_key").distinct()
    wanted = np.unique(np.array([r["_key"] for r in distinct.select("_key").distinct().collect()], np.int64)) if distinct.count() * 16 <= lineage.BROADCAST_BYTES else None
    anchored = bool(keys.where("_size = 0").limit(1).count())

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo = batch.column("_text").to_pylist(), 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= PART_CHARS):
                    chars += len(texts[hi])
                    hi += 1
                text, size, key = keyed(texts[lo:hi], short)
                key = key.view(np.int64)
                use = np.ones(len(key), bool) if anchored else size > 0
                if wanted is not None and len(wanted):
                    use &= wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                text, size, key = (np.unique(np.stack([text[use], size[use], key[use]]), axis=1)) if use.any() else np.zeros((3, 0), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(text + lo)), pa.array(size.astype(np.int32)), pa.array(key)], names=["_row", "_size", "_key"])
                lo = hi

    rows = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("_doc"), F.col(doc_text).alias("_text"))
    near = rows.select(F.xxhash64("_doc", "_text").alias("_row"), "_text").mapInArrow(of_docs, "_row long, _size int, _key long")
    side = F.broadcast(keys) if lineage.small(keys) else keys
    pairs = lineage.cut(near.join(side.drop("_held"), ["_size", "_key"]).select("_row", "_item").distinct())
    pairs = F.broadcast(pairs) if lineage.small(pairs) else pairs
    asked = F.broadcast(mine) if lineage.small(mine) else mine
    found = rows.withColumn("_row", F.xxhash64("_doc", "_text")).join(pairs, "_row").join(asked, "_item").where(F.contains("_text", "_held"))
    found = found.select(F.col("_item").alias(item_id), F.col("_doc").alias(doc_id))
    blank = mine.where("_held = ''").select(F.col("_item").alias(item_id))
    return found if blank.isEmpty() else found.unionByName(blank.crossJoin(rows.select(F.col("_doc").alias(doc_id))))  # the result itself has all these rows


def of_group(table: pa.Table) -> np.ndarray:
    """A number for each group, and for each bucket of one, of a part."""
    by = table.column("_by").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    _, place = np.unique(np.stack([by, table.column("_part").to_numpy()]), axis=1, return_inverse=True)
    return place.ravel().astype(np.int64)
