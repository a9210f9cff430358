"""Spans of long texts: results, and work that doesn't grow with spans times text where it needn't."""

import random
import re
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import anchors, spans


def test_verbatim_rate_makes_the_text_normal_once(spark):
    n = 4000
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("Sentence  number\t"), i.cast("string"), F.lit(" tells of something that is long enough to fill a line"))).alias("all"))
    rows = rows.select(F.transform("all", lambda s, i: F.when(i % 4 == 3, F.concat(s, F.lit(" and more"))).otherwise(F.upper(s))).alias("spans"), F.array_join("all", ". ").alias("text")).cache()
    assert rows.count() == 1
    start = time.monotonic()
    assert rows.select(text.verbatim_rate(F.col("spans"), F.col("text")).alias("r")).first().r == 0.75
    assert time.monotonic() - start < 10  # the text's 300,000 characters made normal for each span take minutes


def test_verbatim_rate_of_nulls(spark):
    rows = spark.createDataFrame([(["a", None, "x"], "A b"), ([], "a"), (None, "a"), (["a"], None), ([""], "")], "spans array<string>, text string")
    got = [r.r for r in rows.select(text.verbatim_rate(F.col("spans"), F.col("text")).alias("r")).collect()]
    assert got == [1 / 3, None, None, 0.0, 1.0]


def test_whole_groups_move_five_columns(spark, monkeypatch):
    index = spark.createDataFrame([(1, 0, "One sentence that is long"), (1, 1, "  \t"), (2, 0, "another")], "d long, sent_id long, text string")
    made = index.selectExpr("d", "sent_id as span_no", "text as span")
    kept, cut = [], anchors.lineage.cut
    monkeypatch.setattr(anchors.lineage, "cut", lambda df: kept.append(df.columns) or cut(df))
    got = {(r.d, r.span_no): (r.n_exact, r.n_within, r.n_around) for r in spans.located(made, index, "d").collect()}
    assert kept == [["_by", "_side", "_no", "_text", "_needle"]]
    assert got == {(1, 0): (1, 1, 1), (1, 1): (0, 0, 1), (2, 0): (1, 1, 1)}


def test_short_texts_are_sorted_out_before_they_are_looked_up(monkeypatch):
    """Of the places where a short text of any group may begin, few are looked up: those of its own group, by bits of the hash."""
    rng, looked_up, find = random.Random(3), [], np.searchsorted
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(90 if i % 2 else 9)) for i in range(4000)]
    texts[0] = texts[1][20:29]
    group, one = np.repeat(np.arange(400), 10), np.ones(len(texts), bool)
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *args: looked_up.append(np.size(v)) or find(a, v, *args))
    a, b = anchors.contained(texts, group, one, one, one)
    assert (0, 1) in zip(a.tolist(), b.tolist(), strict=True)
    assert sum(looked_up) < sum(map(len, texts)) / 8


def test_folded_is_as_before():
    for s in ("", " ", "a  b", "　A\x1cB \t", "ﬁn\r\n", "Straße \x85 x", "İ i"):
        assert spans.folded(s) == re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s)).strip().casefold()


@pytest.mark.parametrize("part", [1 << 20, 200])
@pytest.mark.parametrize("least", [1, 20])
def test_attribution_is_counted_without_pairs(spark, monkeypatch, part, least):
    """Against all pairs; with groups dealt to several tasks, too; repeated numbers, null spans, numbers and groups."""
    monkeypatch.setattr(anchors, "PART_CHARS", part)
    monkeypatch.setattr(spans, "attributed", lambda *a, **k: pytest.fail("pairs were made"))
    rng = random.Random(5)
    base = ["".join(rng.choice("ab c") for _ in range(60)) for _ in range(6)]
    cut = lambda: (lambda t, i: t[i : i + rng.randint(1, 50)])(rng.choice(base), rng.randint(0, 40))
    a = [(rng.choice([1, 2, 3]), i, cut()) for i in range(60)] + [(1, 0, base[0]), (2, None, base[1]), (None, 7, base[2]), (3, 70, None), (3, 71, " "), (4, 0, base[3])]
    b = [(rng.choice([1, 2, 3]), i, cut()) for i in range(60)] + [(1, 60, base[0]), (2, 61, base[1]), (None, 62, base[2]), (3, 63, None), (3, 64, " \t"), (3, 65, "\0" * 20)]
    left, right = spark.createDataFrame(a, "d long, span_no long, span string"), spark.createDataFrame(b, "d long, sent_id long, text string")
    plain = lambda t: None if t is None else " ".join(t.split()).lower()
    hits = {}
    for g, i, s in a:
        s = plain(s)
        near = lambda t: s is not None and len(s) >= least and (s in t or (len(t) >= least and t in s))  # noqa: B023, E731
        hits[g, i] = hits.get((g, i), 0) + (sum(near(plain(t)) for h, _, t in b if h == g and plain(t)) if g is not None and i is not None else 0)
    want = {}
    for g, i, s in a:
        short, n = None if s is None else len(plain(s)) < least, hits[g, i]
        row = want.setdefault(g, [0] * 5)
        for k, yes in enumerate((True, short is True, short is False and n == 0, n > 1, n == 1)):
            row[k] += yes
    got = {r[0]: list(r[1:]) for r in spans.attribution_stats(left, right, "d", least).collect()}
    assert got == want
