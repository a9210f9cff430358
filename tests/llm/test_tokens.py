import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm import tokens
from lodestone.llm.queries import op3_token_orc, op8_byte_bpe

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "\n\n\t \x0b\x0c\r\x1c\x1d\x85\xa0 x", "a\x1cb \x1f\x1f c", "<|endoftext|> <|startoftext|>x", "don't we'll I'M 'S it's", "é ́e ﬁ Ω Ω ΑΣ ΣΑΣ. İ ß ẞ",
    "<|startoftext|> zz", "a<|endoftext|>b<|endoftext|>", "<|EndOfText|> <|STARTOFTEXT|> It's", "<| endoftext|> <|endoftext|", "Don<|startoftext|>'T É",
    "日本語のテキスト 한국어 עברית 🎉👩‍👩‍👧‍👦 é", "x" * 5000, "ab" * 3000 + " " * 700 + "\n" * 30 + "1234567890" * 40, "\x00\x01�￾", "  leading and   trailing  ", "a b　c​d", "!!!???...((()))#$%&", "aaaa aaaaa aaaaaa aaaaaaa", "word " * 20000,
]


def texts_of_sf():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()


def fuzz(n=400):
    rng = random.Random(7)
    pools = ["abcdefgh", "ab ", "'stremvld ", " \t\n\r  ", "0123456789", "éèñüßçıİΣσς", "日本語한글", "!?.,;:-_()[]", "🎉👍🏽‍️", "".join(map(chr, range(0x20)))]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_word_ids_are_those_of_whole_texts():
    t = Tokenizer.from_file(WORD)
    for texts in (ODD, texts_of_sf(), fuzz()):
        want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        assert [x.tolist() for x in tokens.word_ids(texts, WORD)] == want


def test_byte_ids_are_those_of_tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for texts in (ODD, texts_of_sf(), fuzz()):
        got = tokens.byte_ids(texts, BYTE, P.PATTERN)
        for text, ids in zip(texts, got, strict=True):
            assert ids.tolist() == t.encode_ordinary(text or ""), text
            assert tokens.decode_bytes(ids, BYTE) == (text or "").encode()
            assert tokens.decode_text(ids, BYTE) == (text or "")


def test_offsets_cover_the_text_and_split_characters():
    for text in [x for x in ODD[:12] if x]:
        ids = tokens.byte_ids([text], BYTE, P.PATTERN)[0]
        start, end = tokens.offsets(ids, BYTE)
        assert start[0] == 0 and end[-1] == len(text) and (start[1:] <= end[:-1]).all() and (start < end).all()
        for i, a, b in zip(ids, start, end, strict=True):
            data = tokens.byte_table(BYTE)[int(i)]
            assert data in text[a:b].encode()
    ids = tokens.byte_ids(["🎉"], BYTE, P.PATTERN)[0]
    if len(ids) > 1:
        assert "�" in tokens.decode_text(ids[:1], BYTE)
    assert [x.tolist() for x in tokens.offsets(np.zeros(0, np.uint32), BYTE)] == [[], []]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i if i != 5 else None, t, "x", "y") for i, t in enumerate(ODD)] + [(3, "twice", "x", "y"), (3, "twice", "x", "y"), (3, "again", "x", "y")]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, ids string, row string").repartition(5).write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_op3_round_trip(spark, odd_dir):
    d, rows = odd_dir
    t = Tokenizer.from_file(WORD)
    at, want = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, op3_token_orc(spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=key) == sorted(want, key=key)


def test_orc_files_have_bloom_filters_and_are_pruned(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens.write_tokens(docs, f"{tmp_path}/o", WORD, 2)
    got = tokens.read_tokens(spark, f"{tmp_path}/o", [3, 700])
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan
    assert {r.doc_id for r in got.collect()} == {3, 700}
    files = [f for f in (tmp_path / "o").iterdir() if f.suffix == ".orc"]
    assert any(b"doc_id" in f.read_bytes() for f in files)


def test_op8_digests(spark, odd_dir):
    d, rows = odd_dir
    got = sorted(map(tuple, op8_byte_bpe(spark, d).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = tokens.byte_ids([text], BYTE, P.PATTERN)[0]
        want.append((doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_tables_and_kept_columns(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    assert tokens.encode_bytes(empty, BYTE, P.PATTERN).count() == 0
    tokens.write_tokens(empty, f"{tmp_path}/e", WORD, 2)
    assert tokens.token_digests(tokens.read_tokens(spark, f"{tmp_path}/e")).count() == 0
    both = tokens.decode(tokens.encode_bytes(spark.createDataFrame([(1, "é x"), (2, None)], "doc_id long, text string"), BYTE, P.PATTERN, decoded_col="same"), BYTE)
    assert all(r.decoded == r.same == (r.text or "").encode() for r in both.collect())
    full = tokens.encode_bytes(spark.createDataFrame([(1, "é x", "old")], "doc_id long, text string, n_tokens string"), BYTE, P.PATTERN, with_offsets=True)
    assert full.columns == ["doc_id", "text", "n_tokens", "ids", "token_start", "token_end"] and full.first().token_end[-1] == 3


def test_other_rules_send_whole_texts_to_the_library(tmp_path):
    import json

    with open(WORD, encoding="utf-8") as f:
        rules = json.load(f)
    rules["normalizer"] = {"type": "NFC"}  # keeps the case, so texts may not be lower-cased first
    (tmp_path / "t.json").write_text(json.dumps(rules))
    t = Tokenizer.from_file(str(tmp_path / "t.json"))
    texts = [*ODD[:12], "MiXed Case Words"]
    assert tokens._words(str(tmp_path / "t.json")).pieces is None and tokens._words(WORD).pieces is not None
    assert [x.tolist() for x in tokens.word_ids(texts, str(tmp_path / "t.json"))] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_files_stand_in_the_order_of_their_numbers(spark):
    rows = [(f"part-{n:05d}-x.c000.zstd.orc", doc, 0, [7] * size) for n, doc, size in ((99_999, 1, 3), (100_000, 2, 4), (100_001, 3, 5), (7, 0, 2))]
    got = tokens.token_digests(spark.createDataFrame(rows, "file string, doc_id long, row long, token_ids array<int>")).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in got) == [(0, 0, 2), (1, 2, 3), (2, 5, 4), (3, 9, 5)]


def test_op8_digests_are_those_of_tiktoken(spark, odd_dir):
    d, rows = odd_dir
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text, *_ in rows:
        ids = t.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode_bytes(ids)).hexdigest()))
    assert sorted(map(tuple, op8_byte_bpe(spark, d).collect()), key=str) == sorted(want, key=str)


def test_slices_hold_few_rows_and_bytes():
    import pyarrow as pa

    from lodestone.llm.shared import parts

    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (1, 2, 3, 50, 1, 1, 0)] + [None, "é"]})
    got = [p.column("t").to_pylist() for p in parts(batch, "t", 3, 6)]
    assert got == [["a", "aa", "aaa"], ["a" * 50], ["a", "a", ""], [None, "é"]]
