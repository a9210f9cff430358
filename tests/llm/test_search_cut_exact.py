"""Tiered search, fill-in-middle and exact dedup against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact, fim, lexical, quotients, sql
from lodestone.llm.queries import oracle_sql, queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_tiered_search", "op12_fill_in_middle", "op13_exact_dedup"])
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = queries()[name](spark, D)
    want = con.sql(oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


# --- tiered search ---------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked, out = {}, set()
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    for item, words in asked.items():
        scored = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in words if b[t])
            if s > 0:
                scored.append((-s, -(10**9) if i is None else i))
        out |= {(item, rank, None if i == -(10**9) else i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def corpus(seed, count):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 300}"
    return [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("tiers", [((16, 16), (128, 4)), ((1, 1000), (2, 50)), ()])
@pytest.mark.parametrize("asked", [True, False])
def test_search_equals_the_exhaustive_sum(spark, tmp_path, monkeypatch, tiers, asked):
    monkeypatch.setattr(lexical, "TIERS", tiers)
    monkeypatch.setattr(lexical, "_COLUMNS", [f"{p}{t}" for t in range(len(tiers) + 1) for p in lexical._PARTS])
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 700)
    docs = [*enumerate(corpus(1, 300)), (7, "w1 again"), (None, "w1 w2 w3"), (900, None), (901, ""), (902, "É日本 w1,W1;w2")]
    items = [(i, t) for i, t in enumerate(corpus(2, 12))] + [(50, "w290 w1 É日本"), (51, "nothing known"), (52, None), (None, "w1"), (50, "w5")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("term", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build(spark, d, str(tmp_path / "index"), lexical.item_terms(q) if asked else None)
    got = lexical.search(spark, index, q, 10)
    assert {tuple(r) for r in got.collect()} == plain_search(docs, items, 10)


def test_items_fall_through_only_as_far_as_they_must(spark, tmp_path, monkeypatch):
    """One rare term: the first tier holds all its postings, so the item is proved there; a frequent one isn't."""
    read = []
    scored = lexical._scored
    monkeypatch.setattr(lexical, "_scored", lambda shards, items, tier, k: read.append((tier, shards.count())) or scored(shards, items, tier, k))
    docs = spark.createDataFrame([(i, "common " * (1 + i % 5) + ("rare" if i % 100 == 0 else "") + " x" * (i % 7)) for i in range(2000)], "doc_id long, text string")
    index = lexical.build(spark, docs, str(tmp_path / "index"))
    ask = lambda text: lexical.search(spark, index, spark.createDataFrame([(1, text)], "item_id long, text string"), 5).collect()
    assert len(ask("rare")) == 5 and [t for t, _ in read] == [0]
    read.clear()
    ask("x common rare")
    assert [t for t, _ in read] == list(range(len(read))) and len(read) > 1


def test_search_in_blocks_of_items_and_empty_tables(spark, tmp_path, monkeypatch):
    docs, items = [*enumerate(corpus(3, 80))], [*enumerate(corpus(4, 20))]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "ITEM_BYTES", 400)
    index = lexical.build(spark, d, str(tmp_path / "a"))
    assert {tuple(r) for r in lexical.search(spark, index, q, 4).collect()} == plain_search(docs, items, 4)
    assert lexical.top_documents(spark, d.where("false"), q).count() == 0
    assert lexical.top_documents(spark, d, q.where("false")).count() == 0


# --- fill-in-middle --------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cut(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cuts_equal_the_plain_form_and_are_undone(spark):
    odd = ["", None, " ", "\t\n a", "a", "a  ", "  a b\x0b\x0cc \r\n", "日本 語 😀 é x", "has <P> in it", "<S>", "x < P> <", "ends <", "a b c"]
    rows = [(i, odd[i % len(odd)]) for i in range(200)] + [(i, " ".join(["word"] * (i % 90))) for i in range(200, 400)] + [(None, "no id here at all"), (5, "twice"), (5, "twice"), (999, "long " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("old"), "a.b": F.lit(1)})
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out.collect())
    assert got == sorted(repr((i, *plain_cut(i, t))) for i, t in rows)
    assert out.where("not (back <=> coalesce(text, ''))").count() == 0
    assert {"psm", "spm", "plain"} == {r.form for r in out.select("form").distinct().collect()} and "a.b" in out.columns
    assert fim.transform(docs.where("false")).count() == 0


def test_markers_that_could_be_mistaken_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for markers in (("aa", "b", "c"), ("<P", "<PX", "<M>"), ("", "x", "y"), ("ab", "ba", "c")):
        with pytest.raises(ValueError, match="marker"):
            fim.transform(docs, markers=markers)
    out = fim.transform(docs, rate=100, spm=0, markers=("[1", "[2", "[3"), keep_text=False)
    assert out.first().form == "psm" and "text" not in out.columns


# --- exact dedup -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("lead", [0, 1, 7])
def test_filters_lose_nothing_and_merge(lead):
    rng = np.random.default_rng(lead)
    for n in (0, 1, 2, 5, 1000):
        top = np.uint64(rng.integers(0, 1 << lead)) << np.uint64(64 - lead) if lead else np.uint64(0)
        parts = []
        for _ in range(3):
            few = rng.integers(0, 1 << 63, max(1, n // 2) if n else 0, dtype=np.uint64) * np.uint64(2)
            some = np.concatenate([few, few[: n // 3], np.array([0, 1], np.uint64)[:n]])
            parts.append((some & np.uint64((1 << (64 - lead)) - 1)) | top)
        blobs = [quotients.encode(*np.unique(p, return_counts=True), lead) for p in parts]
        for p, b in zip(parts, blobs, strict=True):
            f, c = quotients.decode(b)
            assert dict(zip(f.tolist(), c.tolist(), strict=True)) == Counter(p.tolist())
        f, c = quotients.decode(quotients.merge(blobs, lead))
        assert dict(zip(f.tolist(), c.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist()) and (np.diff(f.astype(object)) > 0).all()
        assert len(blobs[0]) < 60 + 12 * max(1, len(parts[0]))


def plain_dedup(rows):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    out = []
    for i, t in rows:
        same = [j for j, u in rows if normal(u) == normal(t)]
        keep = min((j for j in same if j is not None), default=None)
        out.append((i, keep if len(same) > 1 else i, len(same), i == keep or len(same) == 1, hashlib.sha256(normal(t).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block, gathered", [(1 << 16, 1 << 20), (4, 7)])
def test_groups_of_equal_texts(spark, monkeypatch, block, gathered):
    monkeypatch.setattr(exact, "BLOCK_ROWS", block)
    monkeypatch.setattr(exact, "GATHERED", gathered)
    texts = ["a b", "a  b", "a\tb\n", " a b", "A b", "", None, "é", "é", "a b", "long " * 50_000]
    rows = [(100 - i, texts[i * 7 % len(texts)]) for i in range(60)] + [(None, "only here"), (None, "a b")] + [(1000 + i, f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumns({"fp": F.lit("x"), "keep_id": F.lit(None).cast("string")})
    assert sorted(map(repr, map(tuple, exact.duplicates(spark, docs).collect()))) == sorted(map(repr, plain_dedup(rows)))


def test_one_of_repeated_rows_stays(spark):
    rows = [(5, "x y"), (5, "x  y"), (5, "x y"), (9, "x y"), (None, "n"), (None, "n")]
    got = exact.duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.keep_id, r.group_size, r.kept) for r in got) == {(5, 4, True): 1, (5, 4, False): 3, (None, 2, True): 1, (None, 2, False): 1}
    assert exact.duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bytes_decide_when_fingerprints_agree(spark, monkeypatch):
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c")]
    got = {tuple(r)[:4] for r in exact.duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True)}


def test_sql_names():
    assert {"op11_tiered_search", "op12_fill_in_middle", "op13_exact_dedup"} <= set(oracle_sql()) and sql.EXACT_DEDUP
