"""Call records: keys, resuming, batches, folds over the steps of a question, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import stats
from .corpus import numbered

BATCH = 32


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last by order. An aggregate, so it combines before it shuffles."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r")).select(*keys, "_r.*")


def unfinished(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows whose key isn't done yet."""
    return planned.join(done.select(*keys), keys, "left_anti")


def changed(planned: DataFrame, done: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys of both whose columns differ, null being equal to null, with the names of the columns."""
    a, b = planned.alias("a"), done.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in columns]))
    return a.join(b, keys).select(*keys, differs.alias("differs")).where(F.size("differs") > 0)


def batches(calls: DataFrame, stage: str, order: list[str], size: int = BATCH) -> DataFrame:
    """calls with batch_no, batch_id and place: consecutive calls of a stage, size to a batch. Places are taken by ranges of
    all calls, so a stage may hold any share of them."""
    numbered_calls = stats.numbered_within(calls, [stage], order)
    no = F.floor(F.col("i") / size).cast("long")
    return numbered_calls.withColumns({"place": (F.col("i") % size).cast("int"), "batch_no": no, "batch_id": F.format_string("%s:%06d", F.col(stage), no)}).drop("i", "n")


def batch_certificates(batched: DataFrame, question: str, index: str) -> DataFrame:
    """(batch_id, n_calls, members_sha256): what a finished batch has to agree with."""
    line = F.concat(F.col(question).cast("string"), F.lit("\t"), F.col(index).cast("string"), F.lit("\n"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col("place"), line.alias("l")))), lambda x: x["l"])
    return batched.groupBy("batch_id").agg(F.count("*").alias("n_calls"), F.sha2(F.array_join(lines, ""), 256).alias("members_sha256"))


def largest_first(batched: DataFrame, tokens: str) -> DataFrame:
    """(batch_no, padded, start_order): batches by tokens after padding, the greatest first."""
    sizes = batched.groupBy("batch_id").agg(F.first("batch_no").alias("batch_no"), (F.max(tokens) * F.count("*")).alias("padded"))
    ordered = numbered(sizes.withColumn("_least", -F.col("padded")), ["_least", "batch_id"], "start_order")
    return ordered.withColumn("start_order", F.col("start_order") + 1).drop("_least")


def contiguous(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Rows up to the first gap in index, which has to begin at 0."""
    return df.withColumn("_want", F.row_number().over(Window.partitionBy(*keys).orderBy(index)) - 1).where(F.col("_want") == F.col(index)).drop("_want")


def history(calls: DataFrame, question: str, step: str, success: Column | None = None) -> DataFrame:
    """(question, steps, stopped): the steps in order, as an array, up to the first gap; with success, up to and with the
    first step where it is "no". Steps of a question are few, so they meet in one row."""
    rows = contiguous(calls, [question], step)
    if success is not None:
        failed = F.max((success == "no").cast("int")).over(Window.partitionBy(question).orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_failed", F.coalesce(failed, F.lit(0))).where("_failed = 0").drop("_failed")
    others = [c for c in rows.columns if c not in (question, step)]
    steps = F.sort_array(F.collect_list(F.struct(step, *others)))
    return rows.groupBy(question).agg(steps.alias("steps"))


def last_usable(calls: DataFrame, question: str, step: str, answer: str) -> DataFrame:
    """(question, answer, step) of the last step whose answer is usable."""
    ok = calls.where(text.usable_answer(F.col(answer)))
    return ok.groupBy(question).agg(F.max_by(F.struct(text.collapse(F.col(answer)).alias("answer"), F.col(step).alias("step")), F.col(step)).alias("_r")).select(question, "_r.*")


def final_answers(questions: DataFrame, solo: DataFrame, summary: DataFrame, fallback: DataFrame, question: str) -> DataFrame:
    """(question, answer, source): solo's parsed or salvaged answer where there is a solo record, else the summary's if
    usable, else the last usable one, else none. solo and summary: (question, parsed, salvaged); fallback: last_usable()."""
    s = solo.select(question, F.lit(True).alias("_solo"), F.col("parsed").alias("_sp"), F.col("salvaged").alias("_ss"))
    m = summary.select(question, F.col("parsed").alias("_mp"), F.col("salvaged").alias("_ms"))
    rows = questions.join(s, question, "left").join(m, question, "left").join(fallback.select(question, F.col("answer").alias("_f")), question, "left")
    there = lambda c: F.coalesce(text.collapse(F.col(c)) != "", F.lit(False))
    source = (
        F.when(F.col("_solo") & there("_sp"), "solo_parsed").when(F.col("_solo") & there("_ss"), "solo_salvaged").when(F.col("_solo"), "none")
        .when(text.usable_answer(F.col("_mp")), "summary_parsed").when(text.usable_answer(F.col("_ms")), "summary_salvaged").when(F.col("_f").isNotNull(), "qa_fallback").otherwise("none")
    )
    pick = {"solo_parsed": "_sp", "solo_salvaged": "_ss", "summary_parsed": "_mp", "summary_salvaged": "_ms", "qa_fallback": "_f"}
    answer = F.lit("")
    for name, column in pick.items():
        answer = F.when(F.col("source") == name, text.collapse(F.col(column))).otherwise(answer)
    return rows.withColumn("source", source).select(question, answer.alias("answer"), "source")


def grounded(answer: Column, evidence: Column) -> Column:
    """Whether the answer's tokens stand together in one of the pieces of evidence."""
    needle = text.norm(answer)
    return F.coalesce(F.exists(evidence, lambda t: text.has_phrase(text.norm(t), needle)), F.lit(False))


def grounded_before(df: DataFrame, by: str, turn: str, words: str, answer: str) -> DataFrame:
    """(by, turn, grounded): whether the answer of a turn stands in the words of an earlier one. Normal forms are made once and
    meet in one row for each of by; no turn carries a copy of those before it."""
    row = F.struct(F.col(turn).alias("t"), text.norm(F.col(words)).alias("w"), text.norm(F.col(answer)).alias("a"))
    turns = df.groupBy(by).agg(F.collect_list(row).alias("_turns"))
    found = lambda x: F.exists("_turns", lambda p: F.coalesce((p["t"] < x["t"]) & text.has_phrase(p["w"], x["a"]), F.lit(False)))
    return turns.select(by, F.inline(F.transform("_turns", lambda x: F.struct(x["t"].alias(turn), found(x).alias("grounded")))))


def first_seen(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Each value once for each of keys, where it comes first by order."""
    rest = [c for c in df.columns if c not in (*keys, value)]
    return df.groupBy(*keys, value).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, value, "_r.*")


def merged_counts(df: DataFrame, by: list[str], counts: str) -> DataFrame:
    """(by..., key, n): maps of counts, summed by key."""
    return df.select(*by, F.explode(counts).alias("key", "n")).groupBy(*by, "key").agg(F.sum("n").alias("n"))


def distinct_memory(df: DataFrame, run: str, fingerprint: str, size: str) -> DataFrame:
    """(run, total, peak): memory of the different configurations of a run, each once, and of the greatest."""
    each = df.where(F.col(size) > 0).groupBy(run, fingerprint).agg(F.max(size).alias("s"))
    return each.groupBy(run).agg(F.sum("s").alias("total"), F.max("s").alias("peak"), F.count("*").alias("n_configs"))


def two_configurations(df: DataFrame, run: str, role: str, fingerprint: str) -> DataFrame:
    """Roles that a run serves with more than one configuration: empty for a valid run."""
    return df.groupBy(run, role).agg(F.countDistinct(fingerprint).alias("n")).where("n > 1")


def sequence_confidence(logprobs: Column) -> dict[str, Column]:
    """Mean and least log-probability of a sequence; null for an empty one."""
    n = F.size(logprobs)
    return {"mean": F.when(n > 0, F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x) / n), "least": F.array_min(logprobs)}


def padded(value: Column, tokens: Column, target: Column) -> Column:
    """value with as many fillers as bring tokens up to target: shape-only clones for warm-up."""
    return F.concat(value, F.repeat(F.lit("x "), F.greatest(target - tokens, F.lit(0))))
