"""Token ids: word-level and byte-level BPE by the tokenizers library, and ORC files of token ids.

Both encoders split a text where the tokenizer itself always would, and keep the ids of the pieces they have seen, so
the library encodes each distinct piece once for each worker instead of each occurrence. The ids are those of the
whole text. Vocabulary files are read by path on every machine; nothing is trained or copied.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Pieces that a worker keeps, of words and of bytes, and the longest piece, in characters, that it keeps.
WORD_PIECES, BYTE_PIECES, CACHE_CHARS = 600_000, 300_000, 64
#: Documents that are encoded at a time, by words and by bytes; the latter become a Python string for each piece.
SLICE, BYTE_SLICE = 2500, 400
#: Bytes of text that are encoded by words at a time; by bytes it is shared.SLICE_BYTES.
SLICE_BYTES = 8 << 20

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Pieces:
    """Ids of pieces, packed as 32-bit integers, from encode (many distinct pieces at once) or memory. The pieces seen first are kept; frequent ones
    are among them, and the others are encoded anew in every slice of documents."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int):
        self.encode, self.most, self.known = encode, most, {}

    def ids(self, distinct: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces distinct[codes], joined, and how many each piece has."""
        got = list(map(self.known.get, distinct))
        if None in got:
            new = [piece for piece, ids in zip(distinct, got, strict=True) if ids is None]
            fresh = dict(zip(new, self.encode(new), strict=True))
            got = [fresh[piece] if ids is None else ids for piece, ids in zip(distinct, got, strict=True)]
            for piece in new:
                if len(self.known) >= self.most:
                    break
                if len(piece) <= CACHE_CHARS:
                    self.known[piece] = fresh[piece]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), np.uint32)
        starts, n = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.cumsum(n)
        return flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], n


def _encoder(tokenizer, joint: str | None = None) -> Callable[[list[str]], list[bytes]]:
    """Encodes distinct pieces. joint is a piece that makes one token of its own between two spaces: then many pieces go
    to the library as one text, parted by it, which saves half the time; pieces that hold joint go by themselves."""
    whole = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    mark = whole([joint])[0] if joint else []

    def encode(new: list[str]) -> list[tuple[int, ...]]:
        if len(mark) != 1:
            return [array("I", ids).tobytes() for ids in whole(new)]
        found, plain = {}, [p for p in new if joint not in p and len(p) <= CACHE_CHARS]
        for at in range(0, len(plain), 20_000):
            groups = [plain[i : i + 500] for i in range(at, min(at + 20_000, len(plain)), 500)]
            for group, ids in zip(groups, whole([f" {joint} ".join(g) for g in groups]), strict=True):
                cuts = [-1, *(i for i, x in enumerate(ids) if x == mark[0]), len(ids)]
                if len(cuts) != len(group) + 1:  # the normal form of a piece holds joint
                    continue
                found.update((p, array("I", ids[i + 1 : j]).tobytes()) for p, i, j in zip(group, cuts[:-1], cuts[1:], strict=True))
        others = [p for p in new if p not in found]
        found.update(zip(others, (array("I", ids).tobytes() for ids in whole(others)), strict=True))
        return [found[p] for p in new]

    return encode


#: The normalizer and pre-tokenizer for which word_ids() may part texts at white space.
_PARTED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


@dataclass
class Words:
    """A tokenizer file: the library's own tokenizer, the strings that it takes for added tokens wherever they stand, and
    the pieces of other texts, or None if the file's rules don't allow texts to be parted at white space."""

    whole: object
    added: list[str]
    pieces: Pieces | None


@functools.cache
def _words(path: str) -> Words:
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    added = rules.get("added_tokens") or []
    plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in added)
    pieces = None
    if plain and (rules.get("normalizer"), rules.get("pre_tokenizer")) == _PARTED:
        ordinary = Tokenizer.from_file(path)
        ordinary.encode_special_tokens = True  # a piece in lower case may look like an added token that the text doesn't hold
        pieces = Pieces(_encoder(ordinary, "`"), WORD_PIECES)
    return Words(Tokenizer.from_file(path), [t["content"] for t in added], pieces)


def _cut(ids: np.ndarray, of_piece: np.ndarray, pieces: np.ndarray) -> list[np.ndarray]:
    """ids by text: of_piece ids a piece, pieces pieces a text."""
    ends = np.concatenate([[0], np.cumsum(of_piece)])[np.concatenate([[0], np.cumsum(pieces)])].tolist()
    return [ids[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


#: A letter or digit and a mark other than the apostrophe never share a token of a vocabulary that parts letters, digits
#: and others; a space between them changes nothing, but leaves fewer distinct pieces.
_EDGE = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?%*&$#|()])"


def word_ids(texts: pa.Array | list[str | None], path: str) -> list[np.ndarray]:
    """Ids of whole texts by a tokenizer file, as the library gives them without special tokens around them. If the file's
    rules are _PARTED, no token, normal form or case rule reaches over a space or line feed, and they lower-case; so A-Z
    are lower-cased first and the texts are parted there. Texts that hold an added token go to the library as they are,
    as do all texts by other files."""
    texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
    words = _words(path)
    apart = functools.reduce(pc.or_, [pc.match_substring(texts, t) for t in words.added], pa.array(np.full(len(texts), words.pieces is None)))
    if pc.any(apart).as_py():
        where = apart.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, e in zip(np.flatnonzero(where), words.whole.encode_batch(texts.filter(apart).to_pylist(), add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        if not where.all():
            for i, ids in zip(np.flatnonzero(~where), _by_pieces(texts.filter(pc.invert(apart)), words.pieces), strict=True):
                out[i] = ids
        return out
    return _by_pieces(texts, words.pieces)


def _by_pieces(texts: pa.Array, pieces: Pieces) -> list[np.ndarray]:
    parts = pc.split_pattern(pc.replace_substring_regex(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), _EDGE, r"\1 \2"), " ")
    coded = parts.flatten().dictionary_encode()
    ids, n = pieces.ids(coded.dictionary.to_pylist(), coded.indices.to_numpy())
    return _cut(ids, n, pc.list_value_length(parts).to_numpy())


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable in Latin-1, else
    the next free one from U+0100 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def byte_table(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in _ranks(path).items()}


@functools.cache
def _byte_pieces(path: str) -> Pieces:
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, char = _ranks(path), byte_characters()
    named = {token: "".join(char[b] for b in token) for token in ranks}
    # The ranks allow every pair of tokens whose bytes make a token, so each such pair is a merge, in order of rank.
    merges = [(named[t[:i]], named[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tokenizer = Tokenizer(models.BPE({named[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return Pieces(_encoder(tokenizer), BYTE_PIECES)


def _free_bytes() -> None:
    for kept in (_byte_pieces, _ranks, byte_table):
        kept.cache_clear()


@functools.cache
def _splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def byte_ids(texts: pa.Array | list[str | None], path: str, pattern: str) -> list[np.ndarray]:
    """Ids by a file of ranks, each match of pattern separately."""
    find = _splitter(pattern).findall
    parts = [find(t or "") for t in (texts if isinstance(texts, list) else texts.to_pylist())]
    coded = pa.array(chain.from_iterable(parts), pa.string()).dictionary_encode()
    ids, n = _byte_pieces(path).ids(coded.dictionary.to_pylist(), coded.indices.to_numpy())
    return _cut(ids, n, np.fromiter(map(len, parts), np.int64, len(parts)))


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    """The bytes that the ids stand for. A token may hold part of a character, so bytes are joined before any decoding."""
    return b"".join(map(byte_table(path).__getitem__, ids.tolist()))


def decode_text(ids: np.ndarray, path: str) -> str:
    """The text; where the ids begin or end amid a character, what is left of it becomes U+FFFD."""
    return decode_bytes(ids, path).decode("utf-8", "replace")


def offsets(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last; tokens that share a split character both count it."""
    data = np.frombuffer(decode_bytes(ids, path), np.uint8)
    ends = np.cumsum([len(byte_table(path)[i]) for i in ids.tolist()], dtype=np.int64) if len(ids) else np.zeros(0, np.int64)
    at = np.cumsum((data & 0xC0) != 0x80) - 1  # the character that each byte belongs to
    starts = np.concatenate([[0], ends])[: len(ids)].astype(np.int64)
    return at[starts] if len(ids) else starts, at[ends - 1] + 1 if len(ids) else ends


def _packed(lists: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u4").tobytes() for x in lists], pa.binary())


def encode_bytes(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", n_col: str = "n_tokens", with_offsets: bool = False, keep_text: bool = True, decoded_col: str | None = None) -> DataFrame:
    """docs with n_tokens and ids, a binary of little-endian unsigned 32-bit integers; with_offsets adds token_start and
    token_end, arrays of character positions; without keep_text the text isn't sent back. With
    decoded_col, the ids are decoded again by the same worker, as decode() does it, and that column has the bytes.

    Every row keeps its columns; ones of the new names are replaced. A null text counts as an empty one, which has no
    ids. An empty table gives an empty result.
    """
    new = {n_col: "long", ids_col: "binary"} | ({"token_start": "array<long>", "token_end": "array<long>"} if with_offsets else {}) | ({decoded_col: "binary"} if decoded_col else {})
    kept = docs.drop(*(c for c in new if c != text_col))
    names = [c for c in kept.columns if keep_text or c != text_col]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shared.worker("byte_bpe", _free_bytes):
            for batch in batches:
                for part in shared.parts(batch, text_col, BYTE_SLICE):
                    ids = byte_ids(part.column(text_col), path, pattern)
                    columns = [part.column(n) for n in names]
                    columns += [pa.array([len(x) for x in ids], pa.int64()), _packed(ids)]
                    if with_offsets:
                        both = [offsets(x, path) for x in ids]
                        columns += [pa.array([b[k] for b in both], pa.list_(pa.int64())) for k in (0, 1)]
                    if decoded_col:
                        columns.append(pa.array([decode_bytes(x, path) for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names), *(f"`{n}` {t}" for n, t in new.items())])
    return kept.mapInArrow(encode, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the column decoded: the bytes its ids stand for, null for null ids."""
    kept = encoded.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shared.worker("byte_bpe", _free_bytes):
            for batch in batches:
                for part in shared.parts(batch, ids_col, BYTE_SLICE):
                    out = [None if x is None else decode_bytes(np.frombuffer(x, "<u4"), path) for x in part.column(ids_col).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, out_col])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{out_col}` binary"]))


_FILE = "doc_id long, row long, token_ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20) -> None:
    """Writes the ids of every text, with end_id after each document, as ORC files in ascending doc_id order: the files
    by part number, then the rows of each. token_ids are integers, so ORC writes them by its run-length encoding; each stripe
    has row indexes and a Bloom filter on doc_id.

    doc_id null comes first; rows with one doc_id are ordered by their text; a null text counts as empty. An empty
    table makes a folder without rows. The texts are dealt by ranges of doc_id before they are encoded, so each task
    encodes and writes one range and holds the ids of a slice at a time: at most SLICE documents and SLICE_BYTES of text,
    or one longer document.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        with shared.worker("word_bpe", _words.cache_clear):
            for batch in batches:
                for part in shared.parts(batch, "text", SLICE, SLICE_BYTES):
                    ids = [np.append(x, np.uint32(end_id)) for x in word_ids(part.column("text"), vocabulary)]
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.arange(row, row + len(part))), lists], names=["doc_id", "row", "token_ids"])
                    row += len(part)

    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    orc = {"orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(stripe_bytes), "compression": "zstd"}
    ordered.mapInArrow(encode, _FILE).write.options(**orc).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, row (within its file), token_ids and file. Stripes are read in parallel; doc_ids are looked up through the
    stripes' statistics and Bloom filters."""
    df = spark.read.schema(_FILE).orc(path).select("*", F.col("_metadata.file_name").alias("file"))
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def token_digests(tokens: DataFrame) -> DataFrame:
    """For each document of read_tokens(): doc_id, start (ids of all documents before it), n_tokens and ids_crc32, of the
    ids as little-endian unsigned 32-bit integers. Files stand in the order of their part numbers. Sums within files and
    over files give the starts; only one row for each file meets in one task."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shared.worker("digest"):
            for batch in batches:
                lists = batch.column("token_ids")
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), batch.column("row"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "doc_id", "row", "n_tokens", "ids_crc32"])

    rows = tokens.mapInArrow(digest, "file string, doc_id long, row long, n_tokens long, ids_crc32 long")
    rows = shared.Scratch(tokens.sparkSession, "digests").cut(rows, "rows")
    # part-100000 comes after part-99999: by number, then by name
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return at.join(shared.small(files), "file").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
