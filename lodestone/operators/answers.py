"""Answer records: what retrieval found of a question's gold documents, and how answers and evidence score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import spans

#: Names of a step's queries: the original question, and the task with grounded answers.
ANCHOR, TASK = "original_question_anchor", "grounded_step_task"


def _titles(name: str | None = None) -> Column:
    """Distinct titles in the order of steps; a question's steps are few."""
    row = F.struct("step", "name", "titles")
    listed = F.collect_list(row if name is None else F.when(F.col("name") == name, row))
    return F.array_distinct(F.flatten(F.transform(F.sort_array(listed), lambda x: x["titles"])))


def _share(found: Column, gold: Column) -> Column:
    return F.when(F.size(gold) > 0, F.size(found) / F.size(gold)).otherwise(1.0)


def retrieval_metrics(components: DataFrame, gold: DataFrame, question: str) -> DataFrame:
    """A row for each question of gold (question, gold_titles: array).

    components (question, step, name, attempted, titles: array): each step's queries. Recall is over all titles, over the
    anchor's and over the tasks', null for a kind that was never asked; incremental is what only tasks brought. A question
    without gold titles has recall 1; one without components has asked nothing and found nothing."""
    asked = components.withColumns({"attempted": F.coalesce("attempted", F.lit(False)), "titles": F.coalesce("titles", F.array().cast(components.schema["titles"].dataType))})
    is_task = F.col("attempted") & (F.col("name") == TASK)
    per = asked.groupBy(question).agg(
        F.count_distinct(F.when(F.col("attempted"), F.col("step"))).alias("step_count"), F.count_if("attempted").alias("query_count"), F.count_if(F.col("attempted") & (F.size("titles") == 0)).alias("zero_result_count"),
        F.count_if(F.col("attempted") & (F.col("name") == ANCHOR)).alias("_anchors"), F.count_if(is_task).alias("task_query_count"), _titles().alias("titles"), _titles(ANCHOR).alias("anchor_titles"), _titles(TASK).alias("task_titles"),
    )
    empty = F.array().cast(components.schema["titles"].dataType)
    rows = gold.select(question, F.array_distinct("gold_titles").alias("gold_titles")).join(per, question, "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("step_count", "query_count", "zero_result_count", "_anchors", "task_query_count")} | {c: F.coalesce(c, empty) for c in ("gold_titles", "titles", "anchor_titles", "task_titles")})
    g = F.col("gold_titles")
    found, more = F.array_intersect(g, F.col("titles")), F.array_except(F.array_intersect(g, F.col("task_titles")), F.col("anchor_titles"))
    return rows.select(
        question, "gold_titles", "titles", found.alias("retrieved_gold"), _share(found, g).alias("recall"), (F.size(found) == F.size(g)).alias("all_gold"), "step_count", "query_count", "zero_result_count",
        F.when(F.col("_anchors") > 0, _share(F.array_intersect(g, F.col("anchor_titles")), g)).alias("anchor_recall"), F.when(F.col("task_query_count") > 0, _share(F.array_intersect(g, F.col("task_titles")), g)).alias("task_recall"),
        "task_query_count", (F.col("task_query_count") > 0).alias("followup_fired"), F.when(F.col("step_count") > 0, F.col("task_query_count") / F.col("step_count")).otherwise(0.0).alias("firing_rate"),
        more.alias("incremental_gold"), _share(more, g).alias("incremental_recall"),
    )


def evidence_metrics(pred: DataFrame, gold: DataFrame, questions: DataFrame, question: str, label: str) -> DataFrame:
    """(question, evidence_precision, evidence_recall, evidence_f1, evidence_em) of labels, for each of questions; a
    question without either kind of label scores 1."""
    sets = [df.groupBy(question).agg(F.collect_set(label).alias(c)) for df, c in ((pred, "_p"), (gold, "_g"))]
    rows = questions.select(question).join(sets[0], question, "left").join(sets[1], question, "left")
    none = F.array().cast(sets[0].schema["_p"].dataType)
    return rows.select(question, *[c.alias(f"evidence_{n}") for n, c in spans.set_scores(F.coalesce("_p", none), F.coalesce("_g", none)).items()])


def with_scores(answers: DataFrame, gold: DataFrame, question: str) -> DataFrame:
    """answers (question, answer, ...) with gold_answer, em and f1 by gold (question, gold_answer); null without a gold answer."""
    rows = answers.join(gold.select(question, "gold_answer"), question, "left")
    pred = F.coalesce("answer", F.lit(""))
    return rows.withColumns({"em": text.exact_match(pred, F.col("gold_answer")), "f1": F.when(F.col("gold_answer").isNotNull(), text.token_f1(pred, F.col("gold_answer")))})
