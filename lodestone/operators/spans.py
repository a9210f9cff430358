"""Copied spans: mapping to source sentences, labels of evidence, set scores, churn between runs."""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from . import anchors

#: A fragment shorter than this names no sentence; at most this many spans are accepted.
MIN_CHARS, MAX_SPANS = 25, 3

MAPPED = T.StructType([
    T.StructField("sentences", T.ArrayType(T.StringType())), T.StructField("n_sources", T.IntegerType()), T.StructField("n_inputs", T.IntegerType()), T.StructField("n_accepted", T.IntegerType()),
    T.StructField("n_rejected", T.IntegerType()), T.StructField("reasons", T.MapType(T.StringType(), T.IntegerType())), T.StructField("modes", T.MapType(T.StringType(), T.IntegerType())),
])


def folded(s: str) -> str:
    """Compatibility form, single spaces, folded case."""
    return " ".join(unicodedata.normalize("NFKC", s).split()).casefold()


def located_in(spans: list[list[str]], sources: list[list[str]], least: int = MIN_CHARS) -> list[list[tuple[str, int | None]]]:
    """How each span (folded) of a row maps to one of the row's sources (folded): a mode and the place, or the reason why
    not. All rows are matched at once."""
    every = [(i, s) for texts in (spans, sources) for i, row in enumerate(texts) for s in row]
    n_spans = sum(map(len, spans))
    rows = anchors.Folded(pa.array([s for _, s in every], pa.string()), np.array([i for i, _ in every], np.int64))
    mine = np.arange(len(every)) < n_spans
    in_spans, in_sources = rows.any(mine), rows.any(~mine)
    a, b = anchors.contained(rows.texts, rows.group, np.ones(len(rows.texts), bool), np.ones(len(rows.texts), bool), np.ones(len(rows.texts), bool))
    size = np.fromiter(map(len, rows.texts), np.int64, len(rows.texts))
    n, first = rows.count(~mine), np.full(len(rows.texts), -1)
    place = np.concatenate([np.arange(len(row)) for row in sources]) if sources else np.zeros(0, np.int64)
    first[rows.of[~mine][::-1]] = place[::-1]
    within, around, at = (np.zeros(len(rows.texts), np.int64) for _ in range(3))
    up = in_sources[a] & in_spans[b]
    np.add.at(within, b[up], n[a[up]])
    at[b[up]] = first[a[up]]
    down = in_spans[a] & in_sources[b] & (size[a] >= least)
    np.add.at(around, a[down], n[b[down]])
    at[a[down]] = first[b[down]]

    def how(i: int) -> tuple[str, int | None]:
        if n[i]:
            return ("exact", int(first[i])) if n[i] == 1 else ("ambiguous_sentence", None)
        if within[i] > 1:
            return "multiple_sentences", None
        if within[i] + around[i] == 1:
            return "enclosing" if within[i] else "fragment", int(at[i])
        if within[i] + around[i]:
            return "ambiguous_sentence", None
        return "fragment_too_short" if size[i] < least else "not_in_source", None

    places, lo = rows.of[:n_spans].tolist(), 0
    out = []
    for row in spans:
        out.append([how(i) for i in places[lo : lo + len(row)]])
        lo += len(row)
    return out


def map_spans(spans: list[str | None], sentences: list[str], limit: int = MAX_SPANS) -> dict:
    """Source sentences that the spans stand for, none twice, at most limit, with counts of why and how."""
    return map_rows([spans], [sentences], limit)[0]


def map_rows(spans: list[list[str | None]], sentences: list[list[str]], limit: int = MAX_SPANS) -> list[dict]:
    sources = [[s.strip() for s in row if s and s.strip()] for row in sentences]
    normal = [[folded(s) for s in row] for row in sources]
    asked = [[folded(s) for s in row if s is not None and s.strip()] for row in spans]
    found = located_in(asked, normal)
    return [_mapped_row(*row, limit) for row in zip(spans, sources, normal, found, strict=True)]


def _mapped_row(spans: list[str | None], sources: list[str], normal: list[str], found: list[tuple[str, int | None]], limit: int) -> dict:
    reasons, modes, taken, found = Counter(), Counter(), {}, iter(found)
    for span in spans:
        if span is None or not span.strip():
            reasons["empty_or_non_string"] += 1
            continue
        how, place = next(found)
        if place is None:
            reasons[how] += 1
        elif normal[place] in taken:
            reasons["duplicate_sentence"] += 1
        elif len(taken) == limit:
            reasons["over_limit"] += 1
        else:
            taken[normal[place]] = sources[place]
            modes[how] += 1
    return {"sentences": list(taken.values()), "n_sources": len(sources), "n_inputs": len(spans), "n_accepted": len(taken), "n_rejected": sum(reasons.values()), "reasons": dict(sorted(reasons.items())), "modes": dict(sorted(modes.items()))}


#: Characters of spans and sentences that are mapped at a time.
_CHARS = 1 << 19


@F.pandas_udf(MAPPED)
def mapped(spans: pd.Series, sentences: pd.Series) -> pd.DataFrame:
    rows = [([] if a is None else list(a), [] if b is None else list(b)) for a, b in zip(spans, sentences, strict=True)]
    out, lo = [], 0
    while lo < len(rows):
        hi, chars = lo, 0
        while hi < len(rows) and (hi == lo or chars < _CHARS):
            chars += sum(len(s or "") for texts in rows[hi] for s in texts)
            hi += 1
        out += map_rows([a for a, _ in rows[lo:hi]], [b for _, b in rows[lo:hi]])
        lo = hi
    return pd.DataFrame(out, columns=[f.name for f in MAPPED])


#: Stands for a null span: no sentence is equal to it or holds it.
_NONE = "\0"


def _sides(spans: DataFrame, index: DataFrame, by: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Spans and sentences as anchors.matched() takes them; those of at least that many characters are looked for."""
    s, t = text.loose(F.col("span")), text.loose(F.col("text"))
    looked_for = lambda c: (F.length(c) >= least) & (F.col("_text") != _NONE)
    a = spans.select(F.col(by).alias("_by"), F.col("span_no").cast("long").alias("_no"), F.coalesce(s, F.lit(_NONE)).alias("_text"))
    some = index.where(F.col(by).isNotNull() & F.regexp_like("text", F.lit(r"(?U)\S")))  # normal forms that aren't empty, without making them twice
    b = some.select(F.col(by).alias("_by"), F.col("sent_id").cast("long").alias("_no") if "sent_id" in index.columns else F.lit(0).cast("long").alias("_no"), t.alias("_text"))
    return tuple(x.withColumn("_needle", looked_for("_text")) for x in (a, b))


def located(spans: DataFrame, index: DataFrame, by: str) -> DataFrame:
    """spans (by, span_no, span) with n_exact, n_within and n_around: how many sentences of the same by (index: by, sent_id,
    text) are the span, are in it, have it in them. The set-based twin of located_in(). Texts find each other by anchors
    (operators/anchors.py), so no span is compared with every sentence; an empty span is in all sentences, a null one in none."""

    def count(table: pa.Table) -> pa.Table:
        side, flags = table.column("_side").to_numpy(), {k: table.column(f"_{k}").to_numpy(zero_copy_only=False) for k in ("needle", "hay", "home")}
        rows = anchors.Folded(table.column("_text").combine_chunks(), anchors.of_group(table))
        size = np.fromiter(map(len, rows.texts), np.int64, len(rows.texts))
        home, n = rows.any(flags["home"]), rows.count(side == 1)
        exact, needle = np.where(home, n, 0), rows.any(flags["needle"])
        within, around = exact.copy(), exact.copy()
        a, b = anchors.contained(rows.texts, rows.group, needle & (size > 0), rows.any(flags["hay"]), home)
        within += np.bincount(b, n[a], len(n)).astype(np.int64)
        around += np.bincount(a, n[b], len(n)).astype(np.int64)
        empty = needle & (size == 0)
        around[empty] = np.bincount(rows.group, np.where(home & (size > 0), n, 0), rows.group.max(initial=0) + 1)[rows.group[empty]].astype(np.int64)
        at = np.flatnonzero(side == 0)
        of = rows.of[at]
        mine = table.select(["_by", "_no"]).take(pa.array(at))
        return pa.table({"_by": mine.column("_by"), "_no": mine.column("_no"), "n_exact": pa.array(exact[of]), "n_within": pa.array(within[of]), "n_around": pa.array(around[of])})

    kind = dict(spans.dtypes)
    made, several = anchors.matched(*_sides(spans, index, by, 0), count, f"_by {kind[by]}, _no long, n_exact long, n_within long, n_around long")
    if several:  # a span's counts come from several buckets; one row of a span has its group's sum of each
        made = made.groupBy("_by", "_no").agg(*[F.sum(c).alias(c) for c in ("n_exact", "n_within", "n_around")])
    return made.select(F.col("_by").alias(by), F.col("_no").cast(kind["span_no"]).alias("span_no"), "n_exact", "n_within", "n_around")


def attributed(spans: DataFrame, index: DataFrame, by: str, least: int = MIN_CHARS) -> DataFrame:
    """(by, span_no, sent_id): sentences that a span of at least that length is part of, or that, if they are that long,
    are part of it. Texts find each other by anchors."""
    if least < 1:
        raise ValueError("least must be positive")

    def pairs(table: pa.Table) -> pa.Table:
        side, flags = table.column("_side").to_numpy(), {k: table.column(f"_{k}").to_numpy(zero_copy_only=False) for k in ("needle", "hay", "home")}
        rows = anchors.Folded(table.column("_text").combine_chunks(), anchors.of_group(table))
        home, needle = rows.any(flags["home"]), rows.any(flags["needle"])
        a, b = anchors.contained(rows.texts, rows.group, needle, rows.any(flags["hay"]), home)
        same = np.flatnonzero(home & np.fromiter((len(t) >= least for t in rows.texts), bool, len(rows.texts)))
        s, t = np.concatenate([a, b, same]), np.concatenate([b, a, same])  # a span in a sentence, a sentence in a span, equal ones
        lists = []
        for k in (0, 1):  # rows of each text on this side
            at = np.flatnonzero(side == k)
            order = at[np.argsort(rows.of[at], kind="stable")]
            lists.append((order, np.searchsorted(rows.of[order], np.arange(len(rows.texts) + 1))))
        (span_rows, span_at), (sent_rows, sent_at) = lists
        ns, nt = np.diff(span_at)[s], np.diff(sent_at)[t]
        n = ns * nt
        pair, k = np.repeat(np.arange(len(s)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        left = table.select(["_by", "_no"]).take(pa.array(span_rows[span_at[s][pair] + k // np.maximum(nt[pair], 1)]))
        right = table.column("_no").take(pa.array(sent_rows[sent_at[t][pair] + k % np.maximum(nt[pair], 1)]))
        return pa.table({"_by": left.column("_by"), "_no": left.column("_no"), "sent_id": right})

    kind, of = dict(spans.dtypes), dict(index.dtypes)
    made, _ = anchors.matched(*_sides(spans, index, by, least), pairs, f"_by {kind[by]}, _no long, sent_id long")
    return made.select(F.col("_by").alias(by), F.col("_no").cast(kind["span_no"]).alias("span_no"), F.col("sent_id").cast(of["sent_id"]).alias("sent_id"))


def _tallied(spans: DataFrame, index: DataFrame, by: str, least: int) -> tuple[DataFrame, bool]:
    """(_by, _no, n, short): a row for each span, with how many rows attributed() has for its by and span_no, counted where they
    are found, and whether the span is shorter than least; and whether n is of a bucket only, for groups dealt to several tasks."""
    if least < 1:
        raise ValueError("least must be positive")

    def count(table: pa.Table) -> pa.Table:
        side, flags = table.column("_side").to_numpy(), {k: table.column(f"_{k}").to_numpy(zero_copy_only=False) for k in ("needle", "hay", "home")}
        rows = anchors.Folded(table.column("_text").combine_chunks(), anchors.of_group(table))
        size = np.fromiter(map(len, rows.texts), np.int64, len(rows.texts))
        home, n = rows.any(flags["home"]), rows.count(side == 1)
        a, b = anchors.contained(rows.texts, rows.group, rows.any(flags["needle"]), rows.any(flags["hay"]), home)
        hits = np.where(home & (size >= least), n, 0)
        hits += np.bincount(a, n[b], len(n)).astype(np.int64)
        hits += np.bincount(b, n[a], len(n)).astype(np.int64)
        at = np.flatnonzero(side == 0)
        of, mine = rows.of[at], table.select(["_by", "_no"]).take(pa.array(at))
        no = mine.column("_no").combine_chunks()
        # spans of one number are counted together; one without a number or a group has no rows
        keys, place = np.unique(np.stack([rows.group[of], no.fill_null(0).to_numpy()]), axis=1, return_inverse=True)
        each = np.bincount(place.ravel(), hits[of], keys.shape[1]).astype(np.int64)[place.ravel()]
        each[no.is_null().to_numpy(zero_copy_only=False)] = 0
        null = np.fromiter((t == _NONE for t in rows.texts), bool, len(rows.texts))[of]
        return pa.table({"_by": mine.column("_by"), "_no": no, "n": pa.array(each), "short": pa.array(size[of] < least, mask=null)})

    kind = dict(spans.dtypes)
    return anchors.matched(*_sides(spans, index, by, least), count, f"_by {kind[by]}, _no long, n long, short boolean")


def attribution_stats(spans: DataFrame, index: DataFrame, by: str, least: int = MIN_CHARS) -> DataFrame:
    """(by, n_spans, too_short, unmatched, ambiguous, uniquely): how far attribution can be trusted."""
    rows, several = _tallied(spans, index, by, least)
    rows = rows.withColumnRenamed("_by", by)
    if several:
        hits = rows.groupBy(by, F.col("_no").alias("_at")).agg(F.sum("n").alias("n"))
        rows = spans.select(by, F.col("span_no").cast("long").alias("_at"), (F.length(text.loose(F.col("span"))) < least).alias("short")).join(hits, [by, "_at"], "left")
    n = F.coalesce("n", F.lit(0))
    return rows.groupBy(by).agg(F.count("*").alias("n_spans"), F.count_if("short").alias("too_short"), F.count_if(~F.col("short") & (n == 0)).alias("unmatched"), F.count_if(n > 1).alias("ambiguous"), F.count_if(n == 1).alias("uniquely"))


def set_scores(pred: Column, gold: Column) -> dict[str, Column]:
    """Precision, recall, F1 and exact match of two sets, given as arrays; two empty ones match."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    tp, both_empty = F.size(F.array_intersect(p, g)), (F.size(p) == 0) & (F.size(g) == 0)
    one = lambda c: F.when(both_empty, 1.0).otherwise(c)
    return {
        "precision": one(F.when(F.size(p) > 0, tp / F.size(p)).otherwise(0.0)), "recall": one(F.when(F.size(g) > 0, tp / F.size(g)).otherwise(0.0)),
        "f1": one(F.when(tp > 0, 2.0 * tp / (F.size(p) + F.size(g))).otherwise(0.0)), "em": ((F.size(p) == tp) & (F.size(g) == tp)).cast("double"),
    }


def sequence_changed(a: Column, b: Column) -> Column:
    """Whether two lists differ in normal form, order counting; null is the empty list."""
    n = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: text.loose(x))
    return n(a) != n(b)


def set_changed(a: Column, b: Column) -> Column:
    n = lambda c: F.sort_array(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: text.loose(x))))
    return n(a) != n(b)
