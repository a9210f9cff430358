"""Probes against plain Python over a small corpus."""

import math
import re
from collections import Counter

import pytest

from lodestone.operators import fusion, probes

PASSAGES = [
    (1, "Ada Quill", "Ada Quill wrote the river ballad. She lived in Norvale."),
    (2, "Norvale", "Norvale is a town by the river. Its mill is old."),
    (3, "Tom Birch", "Tom Birch painted mills. He was born in Norvale."),
    (4, "Mill Song", "Mill Song is a ballad about mills and rivers."),
    (5, "Harbour", "The harbour has many ships. Ships bring salt."),
    (6, "Salt Road", "Salt Road leads from Harbour to Norvale."),
    (7, "Old Ballads", "Old Ballads lists the river ballad and Mill Song."),
    (8, "Kite", "A kite flies. Nothing else."),
]
QUESTIONS = [
    (10, "In which town did Ada Quill live", "bridge", ["Who is Ada Quill", "What town is it"]),
    (11, "Did Tom Birch or Ada Quill know Norvale", "comparison", ["Tom Birch", "Ada Quill", "Norvale"]),
    (12, "Where does the road from the ships lead", "bridge", ["road from ships"]),
    (13, "What flies", "bridge", ["what flies"]),
    (14, "zzz qqq", "comparison", ["zzz"]),
]
GOLD = [(10, 1, 1), (10, 2, 2), (11, 1, 2), (11, 3, 1), (12, 6, 1), (12, 5, 2), (12, 2, 3), (13, 8, 1), (14, 8, 1), (14, 4, 2)]
KS = [2, 4]
TITLE, TEXT = {i: t for i, t, _ in PASSAGES}, {i: x for i, _, x in PASSAGES}


def tok(s):
    return re.findall(r"[^\W_]+", s.lower())


def norm(s):
    return " ".join(tok(s))


def search(query, k):
    docs = {i: tok(x) for i, x in TEXT.items()}
    avg = sum(map(len, docs.values())) / len(docs)
    df = Counter(t for ts in docs.values() for t in set(ts))
    score = {}
    for i, ts in docs.items():
        tf = Counter(ts)
        s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for t in tok(query) if tf[t])
        if any(tf[t] for t in tok(query)):
            score[i] = round(s, 6)
    return sorted(score, key=lambda i: (-score[i], i))[:k]


def support(doc):
    return [s.strip() for s in re.split(r"[.!?\n]", TEXT[doc]) if s.strip()][:1]


@pytest.fixture(scope="module")
def tables(spark):
    gold = [(q, d, TITLE[d], p, support(d)) for q, d, p in GOLD]
    return (
        spark.createDataFrame(PASSAGES, "doc_id long, title string, text string"),
        spark.createDataFrame(QUESTIONS, "question_id long, question string, type string, sub_questions array<string>"),
        spark.createDataFrame(gold, "question_id long, doc_id long, title string, place int, support array<string>"),
    )


def golds():
    for q, question, kind, subs in QUESTIONS:
        docs = [d for _, d in sorted((p, d) for x, d, p in GOLD if x == q)]
        if len(docs) > 1:
            yield q, question, subs, docs


def rows(df):
    return {(r.question_id, r.arm, r.k): (r.n_gold, r.n_found, r.n_hidden, r.n_hidden_found) for r in df.collect()}


def counts(docs, hidden, got):
    return len(docs), len(set(docs) & got), len(hidden), len(set(hidden) & got)


def test_bridges(tables):
    want = {}
    for q, question, _, docs in golds():
        hidden = [d for d in docs if norm(TITLE[d]) not in norm(question)]
        for k in KS:
            half, single = max(1, k // 2), search(question, k)
            first = single[:half]

            def follow(bridges):
                per = max(1, half // len(bridges)) if bridges else 0
                return set(first).union(*[search(f"{TITLE[b]} {question}", per) for b in bridges]) if bridges else set(single)

            spans = [s for d in docs if d in first for s in support(d)]
            fresh = [n for n in fusion.names(spans) if norm(n) not in norm(question) and not any(norm(n) in norm(TITLE[d]) for d in first)]
            got = {
                "single": set(single), "oracle": follow(hidden), "two_pass": follow([h for h in hidden if any(norm(TITLE[h]) in norm(TEXT[d]) for d in first)]),
                "span": set(first) | set(search(" ".join(spans) + " " + question, half)) if spans else set(single), "names": set(first) | set(search(" ".join(fresh[:4]), max(1, k - half))) if fresh else set(single),
            }
            want |= {(q, arm, k): counts(docs, hidden, found) for arm, found in got.items()}
    passages, questions, gold = tables
    got = probes.bridges(passages, questions, gold, KS)
    assert rows(got) == want
    report = {(r.level, r.name, r.arm, r.k): r for r in probes.report(got).collect()}
    for k in KS:
        per = [v for (_, arm, kk), v in want.items() if arm == "oracle" and kk == k]
        assert report["all", "all", "oracle", k].recall == pytest.approx(sum(f / n for n, f, _, _ in per) / len(per))
        assert report["all", "all", "single", k].gain == 0 and not report["all", "all", "single", k].marked


def test_a_follow_up_for_each_title_does_not_search_the_question_anew(spark, tables, monkeypatch):
    """Titles grow with the corpus; whole queries do not."""
    sent, search_ = [], probes.postings.search
    monkeypatch.setattr(probes.postings, "search", lambda spark, index, weights, k: sent.append(weights.select("query").distinct().count()) or search_(spark, index, weights, k))
    passages = spark.createDataFrame([*PASSAGES, *((100 + i, f"Title {i}", f"Title {i} names a mill.") for i in range(60))], "doc_id long, title string, text string")
    gold = spark.createDataFrame([(12, 100 + i, f"Title {i}", i, ["It names a mill."]) for i in range(60)], "question_id long, doc_id long, title string, place int, support array<string>")
    got = rows(probes.bridges(passages, tables[1], gold, KS))
    assert {k[1] for k in got} == {"single", "two_pass", "oracle", "span", "names"} and got[12, "oracle", 2][0] == 60
    assert sum(sent) < 10


def test_named_titles(tables):
    want = {}
    for q, question, _, docs in golds():
        named = [d for d in docs if f" {norm(TITLE[d])} " in f" {norm(question)} "]
        hidden = [d for d in docs if d not in named]
        follow = named or docs[:1]
        for k in KS:
            per = max(1, k // (len(follow) + 1))
            want[q, "single", k] = counts(docs, hidden, set(search(question, k)))
            want[q, "oracle", k] = counts(docs, hidden, set(search(question, per)).union(*[search(f"{TITLE[d]} {question}", per) for d in follow]))
    assert rows(probes.named_titles(*tables, KS)) == want


def test_iterated(tables):
    want, late = {}, {}
    for q, question, subs, docs in golds():
        hidden = [d for d in docs if norm(TITLE[d]) not in norm(question)]
        second = f"{TITLE[docs[0]]} {subs[1] if len(subs) > 1 else question}"
        for k in KS:
            per = max(1, k // len(subs))
            naive = [set(search(s, per)) for s in subs]
            oracle = [set(search(subs[0], k // 2)), set(search(second, k // 2))]
            got = {"single": set(search(question, k)), "naive": set().union(*naive), "oracle": set().union(*oracle)}
            want |= {(q, arm, k): counts(docs, hidden, found) for arm, found in got.items()}
            late.setdefault(("naive", k), []).append(docs[1] in set().union(*naive[1:]))
            late.setdefault(("oracle", k), []).append(docs[1] in oracle[1])
    passages, questions, gold = tables
    per, hop2 = probes.iterated(passages, questions, gold, KS)
    assert rows(per) == want
    assert {(r.arm, r.k): (r.n, r.hop2) for r in hop2.collect()} == {a: (len(v), sum(v) / len(v)) for a, v in late.items()}


def test_without_gold(spark, tables):
    passages, questions, gold = tables
    assert probes.bridges(passages, questions, gold.limit(0), KS).count() == 0
