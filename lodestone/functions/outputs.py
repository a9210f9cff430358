"""Model outputs: tolerant search for JSON, schema checks by role, salvage of parts, classes of failure."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

# Classes of outputs, words that mark a refusal, accepted values.
STATUSES = ["ok", "malformed_json", "schema_mismatch", "empty_output", "truncated", "refusal_or_offtopic"]
REFUSALS = ["i cannot", "i can't", "i can not", "i am unable", "i'm unable", "i apologize", "i'm sorry", "i am sorry", "as an ai", "as a language model", "i do not have", "i don't have access", "cannot assist", "can't help with"]
TASK_TYPES, OUTCOMES = {"aggregate", "question-answering"}, {"Successful", "Unsuccessful"}
MAX_STEPS, MAX_SPANS, MAX_WORDS = 5, 3, 12

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)
#: A string (closed or not), or a bracket.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}\[\]]', re.DOTALL)


def closed(text: str, start: int) -> int | None:
    """Where the bracket at start is closed (the place after), counting brackets of its own kind outside strings."""
    opens, depth = text[start], 0
    closes = {"{": "}", "[": "]"}[opens]
    for m in _TOKEN.finditer(text, start):
        depth += (m[0] == opens) - (m[0] == closes)
        if depth == 0:
            return m.end()
    return None


def blobs(text: str) -> Iterator[str]:
    """Pieces that may be JSON: closed brackets that aren't in others, first those of fenced parts, then of the whole text,
    none twice. A bracket that is never closed ends its part."""
    seen = set()
    for part in [*_FENCE.findall(text), text]:
        at = re.compile(r"[{\[]").search(part)
        while at and (end := closed(part, at.start())) is not None:
            piece = part[at.start() : end]
            if piece not in seen:
                seen.add(piece)
                yield piece
            at = re.compile(r"[{\[]").search(part, end)


def decoded(text: str) -> Iterator[object]:
    for piece in blobs(text):
        try:
            yield json.loads(piece)
        except (ValueError, RecursionError):
            continue


def _text(v: object) -> str | None:
    return v.strip() if isinstance(v, str) and v.strip() else None


def _texts(v: object) -> list[str] | None:
    """The list with its strings trimmed, if all are strings that aren't blank."""
    return [x.strip() for x in v] if isinstance(v, list) and all(_text(x) for x in v) else None


def _answer(v: object) -> str | None:
    return _text(str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v)


def _grade(v: object) -> int | None:
    return v if isinstance(v, int) and not isinstance(v, bool) and 0 <= v <= 10 else None


def _yes_no(v: object) -> str | None:
    return v.lower() if isinstance(v, str) and v.lower() in ("yes", "no") else None


def _one_of(values: set[str]) -> Callable[[object], str | None]:
    return lambda v: v if isinstance(v, str) and v in values else None


#: The fields of each role, and what makes a field of a value; None: not valid.
FIELDS: dict[str, dict[str, Callable[[object], object]]] = {
    "planner": {"analysis": _text, "sub_questions": lambda v: _texts(v) or None},
    "step_definer": {"type": _one_of(TASK_TYPES), "task": _text},
    "extractor": {"spans": _texts},
    "qa": {"analysis": _text, "answer": _answer, "success": _yes_no, "rating": _grade},
    "solo": {"answer": _answer},
    "plan_summary": {"output": _one_of(OUTCOMES), "answer": lambda v: v.strip() if isinstance(v, str) else None, "score": _grade},
}


def payload(role: str, value: object) -> dict | None:
    """The role's fields, if value has all of them; other fields don't matter."""
    if not isinstance(value, dict):
        return None
    out = {name: make(value.get(name)) for name, make in FIELDS[role].items()}
    if None in out.values():
        return None
    if role == "plan_summary" and not (out["answer"] if out["output"] == "Successful" else out["score"] == 0):
        return None
    return out


def parse(role: str, raw: str | None, hit_cap: bool | None) -> tuple[str, dict | None]:
    """The class of an output, and its payload if that is ok."""
    if role not in FIELDS:
        raise KeyError(f"unknown role {role!r}")
    text, any_json = (raw or "").strip(), False
    if not text:
        return "empty_output", None
    for value in decoded(text):
        any_json = True
        if (found := payload(role, value)) is not None:
            return "ok", found
    if any_json:
        return "schema_mismatch", None
    if any(mark in text.lower() for mark in REFUSALS):
        return "refusal_or_offtopic", None
    return "truncated" if hit_cap else "malformed_json", None


def _flat(v: list) -> list[str]:
    return [x.strip() for e in v for x in (e if isinstance(e, list) else [e]) if _text(x)]


def salvage(role: str, raw: str | None) -> dict | None:
    """Fields that can still be used of an output that parse() refuses: the first JSON value with any of them."""
    for value in decoded(raw or ""):
        if role == "extractor":
            if isinstance(value, list):
                return {"spans": [x.strip() for x in value if _text(x)]}
            if not isinstance(value, dict):
                continue
            if isinstance(value.get("spans"), list):
                return {"spans": _flat(value["spans"])}
            if not value:
                return {"spans": []}
            if len(value) == 1 and "spans" not in value or len(value) == 1 and isinstance(value.get("spans"), str):
                (only,) = value.values()
                if _text(only):
                    return {"spans": [only.strip()]}
                if isinstance(only, list):
                    return {"spans": [x.strip() for x in only if _text(x)]}
        elif isinstance(value, dict):
            wanted = {"plan_summary": {"answer": _answer}, "qa": {"answer": _answer, "success": _yes_no}}.get(role, FIELDS[role])
            found = {name: x for name, make in wanted.items() if (x := make(value.get(name))) is not None}
            if found:
                return found
    return None


def strict(role: str, raw: str | None) -> bool:
    """Whether the whole output, trimmed, is JSON with the role's fields."""
    try:
        return payload(role, json.loads((raw or "").strip())) is not None
    except (ValueError, RecursionError):
        return False


def compliant(role: str, raw: str | None, parsed: dict | None, sentences: list[str] | None = None) -> bool:
    """Whether an output keeps the role's protocol in full: strict form, and bounds on steps, spans and words. With the
    source sentences, every span has to map to one of its own."""
    from ..operators.spans import map_spans

    if parsed is None or not strict(role, raw):
        return False
    if role == "planner":
        return 1 <= len(parsed["sub_questions"]) <= MAX_STEPS
    if role == "extractor":
        spans = parsed["spans"]
        return len(spans) <= MAX_SPANS and (sentences is None or map_spans(spans, sentences)["n_accepted"] == len(spans))
    return role == "step_definer" or len(parsed["answer"].split()) <= MAX_WORDS


PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("status", "payload", "salvaged")] + [T.StructField(n, T.BooleanType()) for n in ("strict_format_ok", "protocol_ok")])


@F.pandas_udf(PARSED)
def parsed(role: pd.Series, raw: pd.Series, hit_cap: pd.Series) -> pd.DataFrame:
    """struct of status, payload and salvaged (JSON text, null for none), strict_format_ok and protocol_ok."""
    rows = []
    for r, text, cap in zip(role, raw, hit_cap, strict=True):
        status, found = parse(r, text, cap)
        rest = None if status == "ok" else salvage(r, text)
        as_json = lambda v: None if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True)
        rows.append((status, as_json(found), as_json(rest), strict(r, text), compliant(r, text, found)))
    return pd.DataFrame(rows, columns=[f.name for f in PARSED])


@udtf(returnType=T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("blob", T.StringType())]))
class JsonBlobs:
    """json_blobs(text): a row for each piece that may be JSON."""

    def eval(self, text: str):
        for i, piece in enumerate(blobs(text or "")):
            yield i, piece
