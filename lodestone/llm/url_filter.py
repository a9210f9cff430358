"""URL rules, and block decisions carried over redirects and canonical links to aliases. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: So many rules become one expression; more are joined by the suffixes of hosts.
EXPRESSION_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?\s*canonical\b[^>]*>"
_BASE = r"(?is)<base\b[^>]*\bhref\s*=[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def address(url: Column) -> Column:
    """What spellings of one address share: host, path without closing slashes, and the query without utm_ parameters.
    Scheme and fragment don't count. Null for null or no ://."""
    query = F.filter(F.split(F.substring(F.regexp_extract(url, _PARTS, 3), 2, 1 << 30), "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    whole = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))
    return F.when(url.contains("://"), whole)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, null if none does. A rule (verdict, host, path) fits its
    host and all its subdomains if the path begins with its own; ties go to the rule that is first by code point, and of equal ones to allow."""
    best = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]], r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def with_rule(tmp: shared.Scratch, df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """df (host, path, ...) with rule and own, the longest rule's verdict. Long lists of rules are joined by host: each
    distinct host and path meets the rules of its own host's suffixes only."""
    if len(rules) <= EXPRESSION_RULES:
        best = df.withColumn("best", longest_rule(F.col("host"), F.col("path"), rules))
    else:
        names = F.split("host", r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
        table = tmp.spark.createDataFrame(list({(h, p, -len(h + p), h + p, verdict) for verdict, h, p in rules}), "suffix string, begin string, size int, rule string, verdict string")
        sites = tmp.cut(df.select("host", "path").distinct(), "sites")
        met = sites.withColumn("suffix", F.explode(suffixes)).join(shared.small(table, len(rules)), "suffix").where(F.col("path").startswith(F.col("begin")))
        met = tmp.cut(met.groupBy("host", "path").agg(F.min(F.struct("size", "rule", "verdict")).alias("best")), "met")
        best = df.join(shared.small(met), ["host", "path"], "left")
    return best.withColumns({"rule": F.col("best.rule"), "own": F.col("best.verdict")}).drop("best")


def _undotted(path: Column) -> Column:
    """A path that begins with / without its . and .. segments."""
    empty = F.array().cast("array<string>")
    step = lambda up, x: F.when(x == "..", F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(1)))).when(x == ".", up).otherwise(F.concat(up, F.array(x)))
    return F.concat(F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"), F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))


def resolved(to: Column, base: Column) -> Column:
    """The absolute address that to means on a page at base. Null for an empty one, a fragment alone, a scheme without ://
    (mailto:), and for relative ones if base has no ://."""
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    own, tail = F.regexp_extract(to, r"(?s)^[^?#]*", 0), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path(base), "^/", ""), "[^/]*$", ""))
    whole = F.when(to.startswith("//"), F.concat(scheme, F.lit(":"), to)).when(own == "", F.concat(site, path(base), tail))
    whole = whole.otherwise(F.concat(site, _undotted(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))), tail))
    whole = F.when(base.contains("://") & (to != "") & ~to.startswith("#"), whole)
    return F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(~to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), whole)


def _links(pages: DataFrame) -> DataFrame:
    """(a, b): addresses of pages and of what their canonical links and refreshes point to, all of them."""
    tagged = pages.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
    value = lambda t, key, end: F.replace(F.regexp_extract(t, rf"(?is)\b{key}\s*=\s*[\"']?\s*([^\"'\s>{end}]+)", 1), F.lit("&amp;"), F.lit("&"))
    values = lambda pattern, key, end: F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)), lambda t: value(t, key, end))
    base = F.coalesce(resolved(value(F.regexp_extract("html", _BASE, 0), "href", ""), F.col("url")), F.col("url"))
    to = F.explode(F.concat(values(_CANONICAL, "href", ""), values(_REFRESH, "url", ";")))
    return tagged.select("url", base.alias("base"), to.alias("to")).select("url", resolved(F.col("to"), F.col("base")).alias("to"))


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component (an address).

    A page that a rule fits gets the rule's verdict. Any other page gets that of its component: addresses joined by
    redirects (columns url and target), all canonical links and refreshes of the pages, relative ones resolved. A component that
    holds an address that a rule allows is allowed; else one that holds a blocked address is blocked; else it is
    allowed. Addresses that are only pointed to count too. Defined results: a null url, or one without ://, has empty
    host and path, no rule and no component, and is allowed; null html has no links; repeated rows are judged alike; of
    repeated rules with different verdicts the allowing one counts; empty tables give empty results; other columns are ignored.
    """
    tmp = shared.Scratch(spark, "url-filter")
    links = _links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionAll(redirects.select("url", resolved(F.col("target"), F.col("url")).alias("to")))
    links = tmp.cut(links.where("url is not null and to is not null").distinct(), "links")

    def judged(df: DataFrame) -> DataFrame:
        df = df.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "node": address(F.col("url"))})
        return with_rule(tmp, df, rules)

    labels = shared.components(tmp, links.select(address(F.col("url")).alias("a"), address(F.col("to")).alias("b")))
    labels = shared.small(labels)
    placed = judged(pages.select("page_id", "url")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = tmp.cut(placed.select("page_id", "host", "path", "rule", "own", "component"), "pages")
    targets = judged(links.select(F.col("to").alias("url"))).join(labels, "node", "left").select(F.coalesce("component", "node").alias("component"), "own")
    known = placed.select("component", "own").unionAll(targets).where("own is not null and component is not null")
    blocked = known.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed")).where("not allowed").select("component", F.lit(True).alias("blocked"))
    open_ = placed.where("own is null and component is not null").select("component").distinct()
    blocked = tmp.cut(blocked.join(open_, "component", "left_semi"), "blocked")
    out = placed.join(shared.small(blocked), "component", "left")
    verdict = F.coalesce("own", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")
