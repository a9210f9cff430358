"""Texts that stand in others, against comparing all pairs."""

import random

import numpy as np
import pytest

from lodestone.operators import anchors, spans


def made(seed, groups, count, alphabet="ab c", longest=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(10)]
    rows = {}
    for g in range(groups):
        for _ in range(count):
            t = rng.choice(base)
            i = rng.randint(0, len(t) - 1)
            rows[g, t[i : rng.randint(i + 1, len(t))] if rng.random() < 0.6 else rng.choice(base) + t[i:]] = True
    return list(rows)


@pytest.mark.parametrize("alphabet, longest", [("ab c", 60), ("a", 40), ("xyé字 ", 120), ("ab", 14)])
def test_pairs_equal_all_pairs(alphabet, longest):
    for seed in range(15):
        rows = made(seed, 3, 25, alphabet, longest)
        texts, group, one = [t for _, t in rows], np.array([g for g, _ in rows]), np.ones(len(rows), bool)
        a, b = anchors.contained(texts, group, one, one, one)
        got = list(zip(a.tolist(), b.tolist(), strict=True))
        want = {(i, j) for i, (g, s) in enumerate(rows) for j, (h, t) in enumerate(rows) if i != j and g == h and s in t}
        assert len(got) == len(set(got)) and set(got) == want


def test_no_texts_and_empty_ones():
    none = np.zeros(0, bool)
    assert [len(x) for x in anchors.contained([], np.zeros(0, np.int64), none, none, none)] == [0, 0]
    one = np.ones(2, bool)
    assert [x.tolist() for x in anchors.contained(["", "a"], np.zeros(2, np.int64), one, one, one)] == [[], []]


def tables(spark, rows):
    """The first half of each group's texts are spans, the others sentences; repeated rows too."""
    a = [(g, i, t) for i, (g, t) in enumerate(rows) if i % 2] + [(0, 10_000, ""), (0, 10_001, None), (None, 10_002, rows[0][1])]
    b = [(g, i, t) for i, (g, t) in enumerate(rows) if not i % 2] + [(rows[0][0], 20_000, rows[0][1]), (0, 20_001, ""), (0, 20_002, None)]
    return a, b, spark.createDataFrame(a, "d long, span_no long, span string"), spark.createDataFrame(b, "d long, sent_id long, text string")


def plain(t):
    return None if t is None else " ".join(t.split()).lower()


@pytest.mark.parametrize("part", [1 << 20, 200])
def test_located_and_attributed(spark, monkeypatch, part):
    """part 200: every group goes by its anchors to several tasks."""
    monkeypatch.setattr(anchors, "PART_CHARS", part)
    a, b, left, right = tables(spark, made(5, 3, 40))
    sources = [(g, i, plain(t)) for g, i, t in b if plain(t)]
    got = {r.span_no: (r.n_exact, r.n_within, r.n_around) for r in spans.located(left, right, "d").collect()}
    want = {}
    for g, i, s in a:
        of = [t for h, _, t in sources if g is not None and h == g] if s is not None else []
        s = plain(s)
        want[i] = (sum(s == t for t in of), sum(t in s for t in of), sum(s in t for t in of))
    assert got == want
    for least in (1, 20):
        pairs = [(r.span_no, r.sent_id) for r in spans.attributed(left, right, "d", least).collect()]
        near = lambda s, t: len(s) >= least and (s in t or (len(t) >= least and t in s))  # noqa: B023, E731
        assert sorted(pairs) == sorted((i, j) for g, i, s in a for h, j, t in sources if s is not None and g == h and near(plain(s), t))


def test_a_document_of_a_hundred_thousand_sentences(spark):
    n = 100_000
    index = spark.range(n).selectExpr("1L as d", "id as sent_id", "concat('sentence ', id, ' tells of thing ', id * 7 % 1000, ' and its place ', id * 13 % 777) as text")
    made = index.selectExpr("d", "sent_id as span_no", "case sent_id % 3 when 0 then text when 1 then substring(text, 1, 34) else concat(text, ' and more') end as span")
    got = spans.located(made, index, "d")
    rows = got.groupBy().agg({"n_exact": "sum", "span_no": "count"}).first()
    assert rows["sum(n_exact)"] == len(range(0, n, 3)) and rows["count(span_no)"] == n
    assert got.where("n_within + n_around < 1").count() == 0
    assert spans.attributed(made, index, "d").where("span_no = sent_id").count() == n


def test_rows_are_mapped_together_as_alone():
    rows = made(9, 6, 12)
    given = [[t for g, t in rows if g == k][::2] + [None, " "] for k in range(6)]
    sources = [[t for g, t in rows if g == k][1::2] for k in range(6)]
    assert spans.map_rows(given, sources) == [spans.map_spans(a, b) for a, b in zip(given, sources, strict=True)]
    assert spans.map_rows([], []) == []
