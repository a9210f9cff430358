import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import outputs, text
from lodestone.operators import analytics, bm25, corpus, fusion, records, spans, stats
from lodestone.plans import dataflow


def one(spark, column, **values):
    """A column expression over one row of values."""
    kinds = {str: "string", list: "array<string>", int: "long", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


# --- retrieval -------------------------------------------------------------------------------------------------------


def naive_bm25(docs, query):
    tok = lambda s: re.findall(r"[a-z0-9]+", s.lower())
    bags = [Counter(tok(d)) for d in docs]
    avg = sum(sum(b.values()) for b in bags) / len(bags)
    df = Counter(t for b in bags for t in b)
    return [sum(b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / avg)) * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) for t in tok(query) if t in b) for b in bags]


def search(spark, docs, queries, k, **options):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(queries)), "item_id long, text string")
    return bm25.search(d, q, k, **options).orderBy("item_id", "rank").collect()


def test_bm25_equals_the_formula(spark):
    docs = [f"Doc {i} topic{i} concerns subject{i} and region{i % 11} a further note about theme{i % 17} and person{i % 23}" for i in range(60)]
    queries = ["topic5 region5", "theme3 person3 person3 note", "subject59 and nothing"]
    rows = search(spark, docs, queries, 60)
    for q, query in enumerate(queries):
        want = naive_bm25(docs, query)
        got = {r.doc_id: r.score for r in rows if r.item_id == q}
        assert {i for i, s in enumerate(want) if s > 0} == set(got)
        assert all(got[i] == pytest.approx(want[i], abs=1e-5) for i in got)


def test_bm25_ties_unknown_tokens_and_fill(spark):
    assert [r.doc_id for r in search(spark, ["shared text"] * 12, ["shared"], 3)] == [0, 1, 2]
    assert search(spark, ["hello"], ["zzzznotaword"], 3, fill=True) == []
    rows = search(spark, ["beta", "alpha", "gamma"], ["alpha"], 5, fill=True)
    assert [(r.doc_id, r.score > 0) for r in rows] == [(1, True), (0, False), (2, False)]
    assert search(spark, ["alpha"], ["alpha"], 0) == []


def test_first_wins_and_its_reversal(spark):
    schema = "title string, n long, body string"
    a = spark.createDataFrame([("Shared", 0, "a0"), ("A", 1, "a1"), ("Shared", 2, "a2")], schema)
    b = spark.createDataFrame([("Shared", 0, "b0"), ("B", 1, "b1")], schema)
    pick = lambda *s: {r.title: r.body for r in corpus.first_wins(list(s), "title", ["n"]).collect()}
    assert pick(a, b) == {"Shared": "a0", "A": "a1", "B": "b1"} and pick(b, a) == {"Shared": "b0", "A": "a1", "B": "b1"}


def test_corpus_checks(spark):
    with pytest.raises(ValueError, match="empty"):
        corpus.require(spark.createDataFrame([], "title string"), "title")
    with pytest.raises(ValueError, match="Same"):
        corpus.require(spark.createDataFrame([("Same",), ("Same",)], "title string"), "title")


@pytest.mark.parametrize("parts", [1, 7])
def test_numbering_and_fingerprint_ignore_partitions(spark, parts):
    df = spark.createDataFrame([(i, f"t{i * 7 % 50}") for i in range(50)], "id long, t string").repartition(parts)
    assert [r.t for r in corpus.numbered(df, ["t"]).orderBy("corpus_idx").collect()] == sorted(f"t{i}" for i in range(50))
    assert corpus.fingerprint(df, "id", "t").first() == corpus.fingerprint(df.coalesce(1), "id", "t").first()
    assert corpus.fingerprint(df.where("id > 0"), "id", "t").first() != corpus.fingerprint(df, "id", "t").first()


def test_tokens_and_mentions(spark):
    assert one(spark, text.exact_tokens("s"), s="Crème BRÛLÉE, ﬂat_x ４") == ["crème", "brûlée", "flat", "x", "4"]
    said = lambda t, q: one(spark, text.title_mentioned(F.col("t"), F.col("q")), t=t, q=q)
    asked = "In which year did The Lamplighter first come out?"
    assert said("The Lamplighter (novel)", asked) and not said("Harbour Lights", asked)
    assert not said("(album)", "an album") and not said("ink", "drinking")


HERBS = ["anise", "basil", "chive", "dill", "endive", "fennel", "garlic", "hyssop", "ivy", "jasmine"]


@pytest.mark.parametrize(("anchor", "task", "options", "want"), [
    (HERBS, ["oak", "basil", "pine", "yew", "elm"], {}, [*HERBS[:7], "oak", "pine", "yew"]), (HERBS, ["chive", "anise"], {}, HERBS), (["dill"], ["oak", "dill", "pine"], {}, ["dill", "oak", "pine"]),
    (HERBS[:4], ["oak", "oak", "pine"], {"k": 3, "anchor_k": 1}, ["anise", "oak", "pine"]), ([], ["oak"], {}, ["oak"]), (["dill", "dill"], [], {}, ["dill"]),
])
def test_fusion(spark, anchor, task, options, want):
    both = [c.cast("array<string>") for c in (F.col("a"), F.col("t"))]
    rows = spark.createDataFrame([(anchor, task)], "a array<string>, t array<string>")
    assert rows.select(fusion.fuse(*both, **options).alias("x")).first().x == want


def test_names_and_followups(spark):
    assert fusion.names(["it was Ruth van Meer who moved to Ghent", "Ghent is old"]) == ["Ruth van Meer", "Ghent"]
    assert fusion.names(["Later they left. During it", None, ""]) == []
    follow = lambda s, q, t: one(spark, fusion.followup(fusion.candidate_names("s"), F.col("q"), F.col("t")), s=s, q=q, t=t)
    assert follow(["a lighthouse on Skerry Point, drawn by Ada Quill"], "What stands on Skerry Point?", ["Lighthouses"]) == "Ada Quill"
    assert follow(["Quill Press printed it"], "Where?", ["Quill Press of Leith"]) == ""


# --- outputs and spans -----------------------------------------------------------------------------------------------

QA = {"analysis": "x", "answer": "Paris", "success": "Yes", "rating": 3}


@pytest.mark.parametrize(("role", "raw", "cap", "want"), [
    ("qa", json.dumps(QA), False, "ok"), ("qa", "Sure!\n```json\n" + json.dumps(QA) + "\n``` bye", False, "ok"), ("qa", json.dumps(QA | {"answer": 1969}), True, "ok"), ("qa", json.dumps(QA | {"rating": True}), False, "schema_mismatch"),
    ("qa", json.dumps(QA | {"rating": 11}), True, "schema_mismatch"), ("planner", '{"sub', True, "truncated"), ("planner", '{"sub', False, "malformed_json"), ("solo", " \n", True, "empty_output"), ("solo", "I am sorry.", True, "refusal_or_offtopic"),
    ("planner", '{"note": 1} {"analysis": "a", "sub_questions": ["b "]}', False, "ok"), ("planner", '{"analysis": "a", "sub_questions": []}', False, "schema_mismatch"), ("extractor", '{"spans": []}', False, "ok"),
    ("plan_summary", '{"output": "Unsuccessful", "answer": "", "score": 0}', False, "ok"), ("plan_summary", '{"output": "Unsuccessful", "answer": "", "score": 1}', False, "schema_mismatch"), ("plan_summary", '{"output": "Successful", "answer": " ", "score": 1}', False, "schema_mismatch"),
    ("step_definer", '{"type": "other", "task": "t"}', False, "schema_mismatch"), ("solo", '{"answer": "a {\\" b"} trailing [', False, "ok"),
])
def test_classes_of_outputs(role, raw, cap, want):
    assert outputs.parse(role, raw, cap)[0] == want


@pytest.mark.parametrize(("role", "raw", "want"), [
    ("extractor", '["a", " b "]', {"spans": ["a", "b"]}), ("extractor", '{"spans": [["a"], "b", 3]}', {"spans": ["a", "b"]}), ("extractor", '{"text": "only"}', {"spans": ["only"]}), ("extractor", "{}", {"spans": []}), ("extractor", '{"a": 1, "b": 2}', None),
    ("step_definer", '{"type": "aggregate", "task": ""}', {"type": "aggregate"}), ("qa", '{"answer": 3, "success": "NO"}', {"answer": "3", "success": "no"}), ("plan_summary", '{"answer": "x"}', {"answer": "x"}), ("qa", "none", None), ("planner", None, None),
])
def test_salvage(role, raw, want):
    assert outputs.salvage(role, raw) == want


def test_strict_form_and_protocol():
    assert outputs.strict("qa", f" {json.dumps(QA)} ") and not outputs.strict("qa", f"x {json.dumps(QA)}")
    long = json.dumps(QA | {"answer": "w " * 13})
    assert outputs.strict("qa", long) and not outputs.compliant("qa", long, outputs.parse("qa", long, False)[1])
    plan = json.dumps({"analysis": "a", "sub_questions": ["s"] * 6})
    assert not outputs.compliant("planner", plan, outputs.parse("planner", plan, False)[1])


APOLLO = ["Apollo 8 was the first crewed spacecraft to orbit the Moon.", "It launched on December 21, 1968 from Florida.", "The crew read from the book of Genesis on air.", "They returned safely six days later to Earth."]


@pytest.mark.parametrize(("given", "accepted", "reasons", "modes"), [
    ([APOLLO[0]], APOLLO[:1], {}, {"exact": 1}), (["first crewed  spacecraft TO orbit the Moon"], APOLLO[:1], {}, {"fragment": 1}), ([" ".join(APOLLO[:3])], [], {"multiple_sentences": 1}, {}), ([APOLLO[1] + " Truly."], [APOLLO[1]], {}, {"enclosing": 1}),
    ([APOLLO[0], APOLLO[0], *APOLLO[1:]], APOLLO[:3], {"duplicate_sentence": 1, "over_limit": 1}, {"exact": 3}), (["the Moon", "", None], [], {"fragment_too_short": 1, "empty_or_non_string": 2}, {}), (["this sentence is nowhere in it"], [], {"not_in_source": 1}, {}),
])
def test_span_mapping(given, accepted, reasons, modes):
    got = spans.map_spans(given, APOLLO)
    assert (got["sentences"], got["reasons"], got["modes"]) == (accepted, reasons, modes)
    assert got["n_accepted"] + got["n_rejected"] == got["n_inputs"] == len(given)


def test_ambiguous_fragment():
    assert spans.map_spans(["a fragment that is in both of them"], ["x a fragment that is in both of them", "a fragment that is in both of them y"])["reasons"] == {"ambiguous_sentence": 1}


def test_churn_of_lists_and_sets(spark):
    changed = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert changed(spans.sequence_changed, ["a", "b"], ["b", "a"]) and not changed(spans.set_changed, ["a", "b"], ["b", "A "])


# --- metrics ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("pred", "gold", "f1"), [("x x b", "x x c", 2 / 3), ("The Cat!", "cat", 1.0), ("yes", "yes sir", 0.0), ("yes", "Yes.", 1.0), ("", "", 0.0), ("p", "q", 0.0)])
def test_token_f1(spark, pred, gold, f1):
    assert one(spark, text.token_f1(F.col("p"), F.col("g")), p=pred, g=gold) == pytest.approx(f1)


@pytest.mark.parametrize(("answer", "ok"), [("Paris", True), ("  unknown. ", False), ("N/A", False), ("w " * 12, True), ("w " * 13, False), ("", False), ("I don't know!", False)])
def test_usable_answers(spark, answer, ok):
    assert one(spark, text.usable_answer(F.col("a")), a=answer) is ok


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.03), ("f", "c", 0.04), ("f", "d", 0.5)], "f string, name string, p double")
    assert {r.name: round(r.adjusted, 9) for r in stats.holm(df, ["f"], "name", "p").collect()} == {"a": 0.04, "b": 0.09, "c": 0.09, "d": 0.5}


def test_auroc_against_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(float(s), int(y)) for s, y in zip(rng.integers(0, 9, 200) / 3, rng.integers(0, 2, 200), strict=True)]
    df = spark.createDataFrame([*rows, (None, 1)], "s double, y int")
    pos, neg = [[s for s, y in rows if y == c] for c in (1, 0)]
    want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
    assert stats.auroc(df, "s", "y").first().auroc == pytest.approx(want)
    assert stats.auroc(df.where("y = 1"), "s", "y").first().auroc is None


@pytest.mark.parametrize("bins", [1, 10, 49, 50, 100])
def test_calibration_bins_at_their_edges(spark, bins):
    values = [i / bins for i in range(bins + 1)]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "c double").select(stats.bin_of(F.col("c"), bins).alias("b")).collect()]
    assert got == [0, *range(bins)]


def test_calibration_refuses_what_is_no_probability(spark):
    with pytest.raises(Exception, match="outside"):
        stats.calibration_error(spark.createDataFrame([(1.5, 1)], "c double, y int"), "c", "y").collect()


def test_order_interval_takes_places(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(10_000)], "g string, v double")
    r = stats.order_interval(df, ["g"], "v").first()
    assert (r.lo, r.hi) == (250.0, 9750.0)


def test_exact_bootstrap_ignores_row_order_and_shares_draws(spark):
    rows = [("g", i, v, 2 * v) for i, v in enumerate([0.0, 1.0, 3.0, 8.0])]
    run = lambda r: {x.metric: x for x in stats.exact_means(spark.createDataFrame(r, "g string, u long, a double, b double"), ["g"], "u", ["a", "b"], replicates=500, seed=9).collect()}
    a, b = run(rows), run(rows[::-1])
    assert a == b and (a["b"].lo, a["b"].hi) == (2 * a["a"].lo, 2 * a["a"].hi)


def test_hashed_bootstrap_keeps_strata_and_sizes(spark):
    df = spark.createDataFrame([("x", i, 1.0) for i in range(5)] + [("y", i, 10.0) for i in range(3)], "s string, u long, v double")
    got = {(r.s, r.n, r.v) for r in stats.hashed_draws(df, ["s"], "u", ["v"], 20).collect()}
    assert got == {("x", 5, 5.0), ("y", 3, 30.0)}


def test_pairs_need_the_same_units(spark):
    a, b = (spark.createDataFrame(r, "q string, v double") for r in ([("1", 1.0), ("2", 0.0)], [("1", 0.5), ("3", 0.0)]))
    with pytest.raises(Exception, match="different units"):
        analytics.paired(a, b, "q", "v").collect()
    assert {(r.q, r.side) for r in stats.same_units(a, b, "q").collect()} == {("2", "left"), ("3", "right")}


def test_pareto_front(spark):
    rng = np.random.default_rng(1)
    points = [(f"p{i}", int(m), int(g)) for i, (m, g) in enumerate(rng.integers(0, 30, (300, 2)))]
    want = {n for n, m, g in points if not any(a <= m and b >= g and (a < m or b > g) for _, a, b in points)}
    assert {r.n for r in analytics.pareto(spark.createDataFrame(points, "n string, m long, g long"), "n", "m", "g").collect()} == want


@pytest.mark.parametrize(("effects", "margin", "want", "memory"), [([0.0, -0.2, -0.3, -0.4, -2.0], 1.0, {"c2": 2, "c1": 0}, None), ([0.0, -1.0, -1.0, -1.0, -1.0], 0.5, {"c0": 4}, 100.0)])
def test_allocation(spark, effects, margin, want, memory):
    foot = [100.0, 60.0, 40.0, 50.0, 10.0]
    rows = [(role, f"c{i}", e, [e] * 40) for role in "abcd" for i, e in enumerate(effects)]
    got = analytics.allocation(spark.createDataFrame(rows, "role string, configuration string, effect double, draws array<double>"), spark.createDataFrame([(f"c{i}", f) for i, f in enumerate(foot)], "configuration string, footprint double"), list("abcd"), margin).first()
    used = Counter(got.allocation.split(","))
    assert got.lower >= -margin
    best = min((sum(foot[i] for i in set(c)), -sum(effects[i] for i in c)) for c in __import__("itertools").product(range(5), repeat=4) if sum(effects[i] for i in c) >= -margin - 1e-9)
    assert (got.footprint, round(got.effect, 9)) == (best[0], round(-best[1], 9))
    if memory:
        assert used == want and got.footprint == memory


# --- records and dataflow --------------------------------------------------------------------------------------------


def test_gaps_and_last_wins(spark):
    df = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b"), ("q", 3, "c"), ("r", 1, "d")], "q string, i long, v string")
    assert sorted(r.v for r in records.contiguous(df, ["q"], "i").collect()) == ["a", "b"]
    assert {r.q: r.v for r in records.last_wins(df, ["q"], "i").collect()} == {"q": "c", "r": "d"}


def test_final_answers_by_source(spark):
    q = spark.createDataFrame([(i,) for i in range(6)], "question_id long")
    rec = lambda rows: spark.createDataFrame(rows, "question_id long, parsed string, salvaged string")
    solo, summary = rec([(0, "a  b", None), (1, None, "s"), (5, " ", None)]), rec([(2, "sum", None), (3, "unknown", "w " * 20), (5, "sum", None)])
    last = spark.createDataFrame([(3, "fall", 1), (2, "x", 0)], "question_id long, answer string, step long")
    got = {r.question_id: (r.answer, r.source) for r in records.final_answers(q, solo, summary, last, "question_id").collect()}
    assert got == {0: ("a b", "solo_parsed"), 1: ("s", "solo_salvaged"), 2: ("sum", "summary_parsed"), 3: ("fall", "qa_fallback"), 4: ("", "none"), 5: ("", "none")}


class Scripted:
    """Two steps; the second asks about what the first found."""

    def __init__(self, qa=None, task_type="question-answering", task=True):
        self.qa, self.task_type, self.task = qa or {}, task_type, task

    def generate(self, role, fields):
        if role == "planner":
            return json.dumps({"analysis": "a", "sub_questions": ["Which beck flows past Oldmere Castle?", "In which country does that beck end?"]}), False
        if role == "step_definer":
            step = fields["step"]
            return (json.dumps({"type": self.task_type if step == "2" else "question-answering", "task": fields["goal"]}) if self.task else "no json"), False
        if role == "extractor":
            return json.dumps({"spans": [s.strip() + "." for s in fields["document"].split(".") if "flows" in s or "ends" in s]}), False
        if role == "qa":
            first = "flows past" in fields["task"]
            return json.dumps({"analysis": "a", "rating": 5} | (self.qa.get(1 if first else 2) or {"answer": "Tarn Beck" if first else "Norway", "success": "yes"})), False
        return json.dumps({"output": "Successful", "answer": fields["prior"].split("answer: ")[-1], "score": 9}), False


PASSAGES = [(0, "Oldmere Castle stands on a low hill. On its north side Tarn Beck flows past"), (1, "After forty miles Tarn Beck ends in a lake of Norway")] + [(i, f"Recipe {i} for bread") for i in range(2, 30)]


def flow(spark, generator):
    run = dataflow.Run(spark.createDataFrame([("q", "In which country does the beck at Oldmere Castle end?")], "question_id string, question string"), spark.createDataFrame(PASSAGES, "doc_id long, text string"), generator, k=3)
    plans = run.plans()
    return run, plans, run.steps(plans)


def test_second_step_asks_with_what_is_grounded(spark):
    run, plans, steps = flow(spark, Scripted())
    first, second = steps.orderBy("step").collect()
    assert first.query_source == "original_question_anchor" and first.grounded and first.answer == "Tarn Beck"
    assert second.query_source == "grounded_step_task" and "Tarn Beck" in second.query and second.answer == "Norway" and second.grounded
    answer = run.summaries(plans, steps).first()
    assert (answer.parsed, answer.stop_reason) == ("Norway", "plan_complete")


def test_ungrounded_answers_are_withheld(spark):
    _, _, steps = flow(spark, Scripted(qa={1: {"answer": "a mill pond", "success": "yes"}}))
    first, second = steps.orderBy("step").collect()
    assert not first.grounded and second.query_source == "original_question_anchor" and "mill pond" not in second.query


def test_a_no_ends_the_steps(spark):
    run, plans, steps = flow(spark, Scripted(qa={1: {"answer": "Tarn Beck", "success": "no"}}))
    assert steps.count() == 1 and run.summaries(plans, steps).first().stop_reason == "semantic_inability"


def test_missing_tasks_and_aggregates(spark):
    _, _, steps = flow(spark, Scripted(task=False))
    second = steps.where("step = 1").first()
    assert second.task_source == "fallback" and "Prior answers: Tarn Beck" in second.task and "Original question" in second.task
    _, _, steps = flow(spark, Scripted(task_type="aggregate"))
    second = steps.where("step = 1").first()
    assert second.query is None and second.titles == [] and second.n_documents == 0


def test_stages_are_in_order():
    assert dataflow.stages()[:5] == ["planner", "step_definer", "extractor", "qa", "step_definer_step2"] and len(dataflow.stages()) == 18


def test_answers_that_the_task_holds_are_not_asked_again(spark):
    """Part of a word counts: what is left out stands in the task's normal form as a piece of text."""
    _, _, steps = flow(spark, Scripted(qa={1: {"answer": "Beck", "success": "yes"}}))
    second = steps.where("step = 1").first()
    assert second.query == second.task
