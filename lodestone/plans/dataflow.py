"""The multi-step question dataflow: plan, then for each step define a task, retrieve, extract, answer; then summarise.

Every stage is one set-oriented job over all questions. What answers a prompt is a generator: a picklable object whose
generate(role, fields) gives the raw output for one call. Stages of a step are at most MAX_STEPS times three jobs, and
a step's records are checkpointed before the next step reads them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import outputs, text
from ..operators import answers as answer_records
from ..operators import bm25, events, lineage, postings, records, spans

MAX_STEPS, K = 5, 10

PLAN = T.StructType([T.StructField("analysis", T.StringType()), T.StructField("sub_questions", T.ArrayType(T.StringType()))])
TASK = T.StructType([T.StructField("type", T.StringType()), T.StructField("task", T.StringType())])
SPANS = T.StructType([T.StructField("spans", T.ArrayType(T.StringType()))])
ANSWER = T.StructType([T.StructField("answer", T.StringType()), T.StructField("success", T.StringType()), T.StructField("rating", T.IntegerType())])
SUMMARY = T.StructType([T.StructField("output", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("score", T.IntegerType())])

#: Prompt of each role; {} are the fields of a call.
PROMPTS = {
    "planner": "Split the question into at most five steps.\nQuestion: {question}",
    "step_definer": "Plan:\n{plan}\nSo far:\n{prior}\nState the task of step {step}.",
    "extractor": "Task: {task}\nDocument: {document}\nCopy up to three sentences that help.",
    "qa": "Task: {task}\nEvidence:\n{evidence}\nAnswer in at most twelve words.",
    "plan_summary": "Question: {question}\nSteps:\n{prior}\nGive the final answer.",
    "solo": "Passages:\n{evidence}\nQuestion: {question}",
}
ROLES = list(PROMPTS)


def stage_of(role: str, step: int | None = None) -> str:
    """The stage's name: the role, from the second step on with the step's number."""
    return role if not step else f"{role}_step{step + 1}"


def stages() -> list[str]:
    """All stages in the order they run."""
    steps = [stage_of(r, i) for i in range(MAX_STEPS) for r in ("step_definer", "extractor", "qa")]
    return ["planner", *steps, "plan_summary", "solo"]


def prompt(role: str, fields: Column) -> Column:
    """The role's prompt with the call's fields (map) put in."""
    out = F.lit(PROMPTS[role])
    for name in ("question", "plan", "prior", "step", "task", "document", "evidence"):
        if "{" + name + "}" in PROMPTS[role]:
            out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(fields[name], F.lit("")))
    return out


class Generator(Protocol):
    def generate(self, role: str, fields: dict[str, str]) -> tuple[str, bool]:
        """Raw output, and whether it was cut off at the cap."""


class Stub:
    """Answers without a model: plans from the question's clauses, extracts the sentences that share most words with the
    task, answers with the first of them. The same input always gives the same output."""

    def generate(self, role: str, fields: dict[str, str]) -> tuple[str, bool]:
        words = lambda s: set(s.lower().split())
        if role == "planner":
            parts = [p.strip() for p in fields["question"].replace("?", ".").split(".") if p.strip()]
            return json.dumps({"analysis": "by clause", "sub_questions": parts[:2] or ["?"]}), False
        if role == "step_definer":
            return json.dumps({"type": "question-answering", "task": fields["goal"]}), False
        if role == "extractor":
            pieces = [p.strip() for p in fields["document"].replace("\n", ".").split(".") if p.strip()]
            best = sorted(pieces, key=lambda p: (-len(words(p) & words(fields["task"])), pieces.index(p)))[:2]
            return json.dumps({"spans": best}), False
        if role == "qa":
            first = fields["evidence"].split("\n")[0].removeprefix("- ").split()
            found = bool(first) and "(no evidence collected)" not in fields["evidence"]
            return json.dumps({"analysis": "first", "answer": " ".join(first[:3]) if found else "unknown", "success": "Yes" if found else "No", "rating": 5}), False
        last = [x for x in fields.get("prior", "").split("\n") if "answer: " in x]
        answer = last[-1].split("answer: ")[1] if last else ""
        return json.dumps({"output": "Successful" if answer else "Unsuccessful", "answer": answer, "score": 5 if answer else 0}), False


@dataclass
class Run:
    """questions (question_id, question), passages (doc_id, text), and what has been generated so far."""

    questions: DataFrame
    passages: DataFrame
    generator: Generator
    k: int = K
    calls: list[DataFrame] = field(default_factory=list)
    made: DataFrame | None = None
    index: postings.Index | None = None  # made by the first step that asks, searched by all

    def call(self, planned: DataFrame, role: str, stage: str, payload: T.StructType) -> DataFrame:
        """planned (question_id, call_index, fields, ...) with out (the payload, parsed or salvaged), source and status.
        Records are checkpointed, so a generator answers each call once."""
        generator = self.generator
        lineage.small_batches(planned.sparkSession)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                got = [generator.generate(role, dict(f)) for f in pdf["fields"]]
                yield pdf.assign(raw=[g[0] for g in got], hit_cap=[g[1] for g in got])

        schema = T.StructType([*planned.schema.fields, T.StructField("raw", T.StringType()), T.StructField("hit_cap", T.BooleanType())])
        made = planned.mapInPandas(run, schema).withColumn("p", outputs.parsed(F.lit(role), "raw", "hit_cap"))
        made = made.withColumn("source", F.when(F.col("p.payload").isNotNull(), "parsed").when(F.col("p.salvaged").isNotNull(), "salvaged").otherwise("fallback"))
        made = made.withColumn("out", F.from_json(F.coalesce("p.payload", "p.salvaged"), payload)).withColumn("status", F.col("p.status")).drop("p")
        made = lineage.cut(made)
        kept = made.select("question_id", F.lit(stage).alias("stage"), F.lit(role).alias("role"), "call_index", "raw", "hit_cap", "status", "source", F.sha2(prompt(role, F.col("fields")), 256).alias("prompt_sha256"))
        self.calls.append(kept)
        return made

    def plans(self) -> DataFrame:
        """(question_id, question, plan): one to MAX_STEPS steps; the question itself where planning failed."""
        fields = F.create_map(F.lit("question"), F.col("question"))
        made = self.call(self.questions.select("question_id", "question", F.lit(0).alias("call_index"), fields.alias("fields")), "planner", "planner", PLAN)
        steps = F.when(F.size("out.sub_questions") > 0, F.slice("out.sub_questions", 1, MAX_STEPS)).otherwise(F.array("question"))
        return made.select("question_id", "question", steps.alias("plan"))

    def step(self, plans: DataFrame, past: DataFrame, i: int) -> DataFrame:
        """Records of step i: (question_id, step, sub_question, type, task, task_source, query, query_source, titles,
        evidence, n_documents, n_blocks, n_spans, n_accepted, reasons, modes, answer, success, rating, grounded, event)."""
        active = plans.where(F.size("plan") > i)
        active = active.join(past.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("step", "sub_question", "answer", "grounded", "success"))).alias("past")), "question_id", "left")
        active = active.withColumn("past", F.coalesce("past", F.array().cast(active.schema["past"].dataType)))
        if i:
            active = active.where((F.size("past") == i) & ~F.coalesce(F.element_at("past", -1)["success"] == "no", F.lit(False)))
        known = F.array_distinct(F.transform(F.filter("past", lambda p: p["grounded"]), lambda p: text.collapse(p["answer"])))
        prior = F.array_join(F.transform("past", lambda p: F.concat(F.lit("- "), p["sub_question"], F.when(p["grounded"], F.concat(F.lit(" | answer: "), p["answer"])).otherwise(F.lit(" | answer withheld")))), "\n")
        active = active.withColumns({"known": known, "prior": prior, "goal": F.get("plan", F.lit(i))})
        plan_text = F.array_join(F.transform("plan", lambda s, n: F.concat((n + 1).cast("string"), F.lit(". "), s)), "\n")
        fields = F.create_map(F.lit("question"), "question", F.lit("plan"), plan_text, F.lit("prior"), "prior", F.lit("step"), F.lit(str(i + 1)), F.lit("goal"), "goal")
        defined = self.call(active.withColumns({"call_index": F.lit(i), "fields": fields}).drop("past", "plan"), "step_definer", stage_of("step_definer", i), TASK)

        has = F.coalesce(F.trim("out.task") != "", F.lit(False))
        composed = F.concat(F.lit("Current goal: "), "goal", F.lit(" | Prior answers: "), F.when(F.size("known") > 0, F.array_join("known", "; ")).otherwise("(none yet)"), F.lit(" | Original question: "), "question")
        kind = F.when(has & F.col("out.type").isin(*outputs.TASK_TYPES), F.col("out.type")).otherwise("question-answering")
        tasks = defined.select("question_id", "question", "goal", "known", kind.alias("type"), F.when(has, F.trim("out.task")).otherwise(composed).alias("task"), F.when(has, F.col("source")).otherwise("fallback").alias("task_source"))
        follow = F.size("known") > 0 if i else F.lit(False)
        unseen = F.filter("known", lambda a: ~F.contains(text.norm(F.col("task")), text.norm(a)))
        query = F.when(follow, F.array_join(F.concat(F.array("task"), unseen), " | ")).otherwise(F.col("question"))
        asks = F.col("type") != "aggregate"
        tasks = lineage.cut(tasks.withColumns({"query": F.when(asks, query), "query_source": F.when(asks, F.when(follow, "grounded_step_task").otherwise("original_question_anchor"))}))

        if self.index is None:
            self.index = bm25.index(self.passages)
        ranked = bm25.search(self.index, tasks.where("query is not null"), self.k, query_id="question_id", query_text="query", fill=self.passages)
        read = ranked.join(self.passages.select("doc_id", F.col("text").alias("document")), "doc_id").join(tasks.select("question_id", "task"), "question_id")
        fields = F.create_map(F.lit("task"), F.col("task"), F.lit("document"), F.col("document"))
        planned = read.select("question_id", (F.col("rank") - 1).alias("call_index"), "doc_id", "document", fields.alias("fields"))
        extracted = self.call(planned, "extractor", stage_of("extractor", i), SPANS)
        mapped = extracted.withColumn("m", spans.mapped("out.spans", text.sentences(F.col("document"))))
        mapped = lineage.cut(mapped.select("question_id", F.col("call_index").alias("doc_rank"), "doc_id", F.col("m.sentences").alias("sentences"), F.col("m.n_inputs").alias("n_inputs"), F.col("m.n_accepted").alias("n_accepted"), F.col("m.reasons").alias("reasons"), F.col("m.modes").alias("modes")))
        lines = mapped.select("question_id", "doc_rank", F.posexplode("sentences").alias("pos", "span"))
        seen = records.first_seen(lines, ["question_id"], "span", ["doc_rank", "pos"])
        evidence = seen.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_rank", "pos", "span"))), lambda x: x["span"]).alias("evidence"), F.countDistinct("doc_rank").alias("n_blocks"))
        totals = mapped.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_rank", "doc_id"))), lambda x: x["doc_id"]).alias("titles"), F.count("*").alias("n_documents"), F.sum("n_inputs").alias("n_spans"), F.sum("n_accepted").alias("n_accepted"))
        ready = tasks.join(totals, "question_id", "left").join(evidence, "question_id", "left")
        for counts in ("reasons", "modes"):
            ready = ready.join(_merged(mapped, counts), "question_id", "left").withColumn(counts, F.coalesce(counts, F.create_map().cast("map<string,bigint>")))
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
        ready = ready.withColumns({"evidence": none("evidence", "array<string>"), "titles": none("titles", "array<bigint>")} | {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_documents", "n_blocks", "n_spans", "n_accepted")})
        shown = F.concat("evidence", F.when(F.col("type") == "aggregate", F.col("known")).otherwise(F.array().cast("array<string>")))
        bullets = F.when(F.size(shown) > 0, F.array_join(F.transform(shown, lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise("(no evidence collected)")
        fields = F.create_map(F.lit("task"), F.col("task"), F.lit("evidence"), bullets)
        answered = self.call(ready.withColumns({"call_index": F.lit(i), "fields": fields}), "qa", stage_of("qa", i), ANSWER)
        answer = F.coalesce("out.answer", F.lit(""))
        made = answered.select(
            "question_id", F.lit(i).alias("step"), F.col("goal").alias("sub_question"), "type", "task", "task_source", "query", "query_source", "titles", "evidence", "n_documents", "n_blocks", "n_spans", "n_accepted", "reasons", "modes",
            answer.alias("answer"), F.lower("out.success").alias("success"), F.col("out.rating").alias("rating"), records.grounded(answer, F.concat("evidence", "known")).alias("grounded"),
        )
        return events.rebuilt(made, "query_source", "query", "titles")

    def steps(self, plans: DataFrame) -> DataFrame:
        past = None
        for i in range(MAX_STEPS):
            made = self.step(plans, past if past is not None else _no_steps(plans), i)
            made = lineage.cut(made)
            past = made if past is None else past.unionByName(made)
            if made.isEmpty():  # no question goes on, so later stages have no calls
                break
        return past

    def summaries(self, plans: DataFrame, steps: DataFrame) -> DataFrame:
        """(question_id, stop_reason, parsed, salvaged): only for questions whose steps have come to an end."""
        done = steps.groupBy("question_id").agg(F.count("*").alias("n"), F.max_by("success", "step").alias("last"), F.sort_array(F.collect_list(F.struct("step", "sub_question", "answer"))).alias("past"))
        rows = plans.join(done, "question_id").where((F.col("n") == F.size("plan")) | (F.col("last") == "no"))
        prior = F.array_join(F.transform("past", lambda p: F.concat(p["sub_question"], F.lit(" | answer: "), p["answer"])), "\n")
        fields = F.create_map(F.lit("question"), F.col("question"), F.lit("prior"), prior)
        reason = F.when(F.col("last") == "no", "semantic_inability").otherwise("plan_complete")
        made = self.call(rows.select("question_id", reason.alias("stop_reason"), F.lit(0).alias("call_index"), fields.alias("fields")), "plan_summary", "plan_summary", SUMMARY)
        by = lambda source: F.when(F.col("source") == source, F.col("out.answer"))
        return made.select("question_id", "stop_reason", by("parsed").alias("parsed"), by("salvaged").alias("salvaged"))

    def answers(self) -> DataFrame:
        """One row for each question: prediction, where it comes from, and what the steps did."""
        plans = lineage.cut(self.plans())
        steps = self.steps(plans)
        summary = self.summaries(plans, steps)
        last = records.last_usable(steps, "question_id", "step", "answer")
        no_solo = summary.select("question_id", "parsed", "salvaged").limit(0)
        final = records.final_answers(self.questions, no_solo, summary, last, "question_id")
        rate = lambda c: F.when(F.count("*") > 0, F.count_if(c) / F.count("*"))
        did = steps.groupBy("question_id").agg(
            F.count("*").alias("executed_steps"), F.count_if(text.usable_answer(F.col("answer"))).alias("usable_answers"), F.count_if("grounded").alias("grounded_answers"), rate(F.col("grounded")).alias("grounded_rate"),
            F.count("query").alias("query_count"), F.count_if(F.col("query_source") == "grounded_step_task").alias("followups"), F.size(F.array_distinct(F.flatten(F.collect_list("titles")))).alias("n_titles"), F.sum("n_spans").alias("n_spans"),
            F.sum("n_accepted").alias("n_accepted"), F.sum("n_documents").alias("n_documents"), F.sum("n_blocks").alias("n_blocks"),
        )
        self.made = steps
        depth = plans.select("question_id", F.size("plan").alias("plan_depth"))
        for counts in ("reasons", "modes"):
            final = final.join(_merged(steps, counts), "question_id", "left").withColumn(counts, F.coalesce(counts, F.create_map().cast("map<string,bigint>")))
        return final.join(depth, "question_id").join(did, "question_id", "left").join(summary.select("question_id", "stop_reason"), "question_id", "left")

    def scored(self, gold: DataFrame) -> DataFrame:
        """answers() with exact match and F1, what retrieval found, and how far the evidence is the gold one, by gold (question_id,
        gold_answer, gold_titles: array of doc_id, and gold_sentences: array, if evidence is to be scored). What was asked comes
        from the steps' events."""
        done = answer_records.with_scores(self.answers(), gold, "question_id").drop("query_count")  # retrieval has it
        titles = gold.withColumn("gold_titles", F.col("gold_titles").cast("array<string>"))
        done = done.join(answer_records.retrieval_metrics(events.listed(self.made, ["question_id", "step"]), titles, "question_id"), "question_id", "left")
        if "gold_sentences" not in gold.columns:
            return done
        labels = lambda df, c: df.select("question_id", F.explode(c).alias("_s")).select("question_id", text.loose(F.col("_s")).alias("label"))
        return done.join(answer_records.evidence_metrics(labels(self.made, "evidence"), labels(gold, "gold_sentences"), self.questions, "question_id", "label"), "question_id", "left")

    def all_calls(self) -> DataFrame:
        out = self.calls[0]
        for c in self.calls[1:]:
            out = out.unionByName(c)
        return out


def _merged(rows: DataFrame, counts: str) -> DataFrame:
    """(question_id, counts): the maps of a question's rows as one; keys are the few kinds of reasons."""
    each = records.merged_counts(rows, ["question_id"], counts)
    return each.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("n").cast("long").alias("n"))))).alias(counts))


def _no_steps(plans: DataFrame) -> DataFrame:
    return plans.limit(0).select("question_id", F.lit(0).alias("step"), F.lit("").alias("sub_question"), F.lit("").alias("answer"), F.lit(False).alias("grounded"), F.lit("").alias("success"))


def solo(questions: DataFrame, passages: DataFrame, generator: Generator, k: int = K) -> Run:
    """The one-call control: the k best passages and the question. Its calls are in the run that is returned."""
    run = Run(questions, passages, generator, k)
    ranked = bm25.search(passages, questions, k, query_id="question_id", query_text="question", fill=True).join(passages.select("doc_id", "text"), "doc_id")
    shown = ranked.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("evidence"))
    fields = F.create_map(F.lit("question"), F.col("question"), F.lit("evidence"), F.coalesce("evidence", F.lit("")), F.lit("prior"), F.lit(""))
    planned = questions.join(shown, "question_id", "left").select("question_id", F.lit(0).alias("call_index"), fields.alias("fields"))
    run.call(planned, "solo", "solo", ANSWER)
    return run

