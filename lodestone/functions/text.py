"""Text as column expressions: tokens, normal forms, phrase tests, hashes. Variants named exact_ follow Unicode to the
letter and run as Arrow-batched pandas functions; the others stay in the JVM."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII punctuation, which answers are stripped of.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: What usable_answer() strips from both ends before it looks for a sentinel.
ANSWER_EDGES = " \t\r\n.,;:!?\"'`()[]{}"
#: Answers that say there is none.
NO_ANSWER = ["unknown", "no answer", "no answer found", "no relevant information", "no relevant information found", "not enough information", "insufficient information", "cannot determine", "unable to determine", "i don't know", "n/a", "none"]
MAX_ANSWER_WORDS = 12


def tokens(c: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def norm(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


@F.pandas_udf(T.ArrayType(T.StringType()))
def exact_tokens(s: pd.Series) -> pd.Series:
    """Compatibility forms are composed and case is folded before the split, so ligatures and wide letters match."""
    return s.map(lambda t: re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t).casefold()), na_action="ignore")


def ascii_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9: what early probes went by."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def collapse(c: Column) -> Column:
    """White space made one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def loose(c: Column) -> Column:
    """collapse(), lower-cased: what copied text is compared by."""
    return F.lower(collapse(c))


def passage_text(sentences: Column) -> Column:
    return F.trim(F.array_join(F.transform(sentences, lambda s: F.trim(s)), " "))


def sentences(c: Column) -> Column:
    """Trimmed, non-empty pieces between . ! ? and line feeds."""
    return F.filter(F.transform(F.split(c, r"[.!?\n]"), lambda s: F.trim(s)), lambda s: s != "")


def has_phrase(normed: Column, phrase: Column) -> Column:
    """Whether the tokens of phrase stand together, in order, in normed; both are norm()s. An empty phrase never does."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), normed, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def title_mentioned(title: Column, question: Column) -> Column:
    """Whether the question names the title; a closing bracket, as in "Vogue (magazine)", doesn't count."""
    return has_phrase(norm(question), norm(F.regexp_replace(title, r"\s*\([^()]*\)\s*$", "")))


def answer_norm(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(c), PUNCTUATION, "")
    return collapse(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "))


def exact_match(pred: Column, gold: Column) -> Column:
    return (answer_norm(pred) == answer_norm(gold)).cast("double")


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the two bags of words of normal forms; yes, no and noanswer have to match as a whole."""
    p, g = answer_norm(pred), answer_norm(gold)
    a, b = F.filter(F.split(p, " "), lambda w: w != ""), F.filter(F.split(g, " "), lambda w: w != "")
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))
    special = p.isin("yes", "no", "noanswer") | g.isin("yes", "no", "noanswer")
    return F.when(special & (p != g), 0.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def usable_answer(c: Column) -> Column:
    """At most MAX_ANSWER_WORDS words, at least one, and not a way to say that there is no answer."""
    plain = collapse(c)
    bare = F.btrim(F.lower(plain), F.lit(ANSWER_EDGES))
    return F.coalesce((plain != "") & (F.size(F.split(plain, " ")) <= MAX_ANSWER_WORDS) & ~bare.isin(NO_ANSWER), F.lit(False))


def verbatim_rate(spans: Column, text: Column) -> Column:
    """Share of spans that stand in text, null without spans. The normal form of text is an array's one member, so it is made
    once a row rather than for each span."""
    held = F.transform(F.array(loose(text)), lambda t: F.size(F.filter(spans, lambda s: F.contains(t, loose(s)))))
    return F.when(F.size(spans) > 0, F.get(held, F.lit(0)) / F.size(spans))


def slug(c: Column) -> Column:
    """The last part of a path-like name in lower case, without an -instruct at its end, other marks as dashes."""
    last = F.lower(F.element_at(F.split(c, "/"), -1))
    return F.regexp_replace(F.regexp_replace(last, "-instruct$", ""), r"[^a-z0-9.]+", "-")


def lines_hash(ids: Column) -> Column:
    """SHA-256 of the strings of an array, one a line."""
    return F.sha2(F.array_join(ids, "\n"), 256)


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, no escapes: equal values have equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical(s: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null if it isn't JSON."""

    def one(t: str) -> str | None:
        try:
            return canonical_json(json.loads(t))
        except ValueError:
            return None

    return s.map(one, na_action="ignore")


def gpu_uuid(c: Column) -> Column:
    """A whole device id in lower case, with its prefix; null if it isn't one."""
    u = F.lower(F.trim(c))
    return F.when(F.regexp_like(u, F.lit("^gpu-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")), F.concat(F.lit("GPU-"), F.substring(u, 5, 36)))
