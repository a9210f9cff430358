import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, sql, url_filter
from lodestone.llm.queries import RULES, op6_url_filter, op7_mixing
from lodestone.llm.shared import Scratch, components


def by_duckdb(folder, query, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    rel = con.sql(query)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted(([r[i] for i in at] for r in rel.limit(10**9).fetchall()), key=str)


def collected(df):
    return sorted(([r[c] for c in sorted(df.columns)] for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(700, 800)] + [(None, 3), (5, 5)]
    parent = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a in parent and b in parent and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {n: root(n) for n in parent}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


URLS = [
    (1, "http://A.Example.COM/en/x?y#z"), (2, "https://www.example.com/en/"), (3, "x://net/es/1"), (4, "http://b.net/fr"), (5, "http://b.net/fr/"), (6, None), (7, "no scheme"), (8, ""),
    (9, "http://notexample.com/en/"), (10, "http://example.com?/en/"), (11, "http://com"), (12, "http://com/"), (13, "a://b://net/es/"), (14, "http://q.org/É?utm_source=1&b=2#f"), (15, "//net/es/"), (16, "http://www.example.com/en/1"),
    (17, "http://m.www.example.com/en/1"), (18, "http://q.org/p/?utm_x=1"), (18, "http://q.org/p/?utm_x=1"), (None, "http://z.net/es/"), (19, "http://ÀB.NET/es/"), (20, "http://x.net/es/\nline"),
]


def link(to):
    return f'<html><LINK href="{to}" rel=canonical></html>'


def test_op6_against_sql(spark, tmp_path):
    html = {14: link("http://blocked.net/es/1"), 18: '<meta http-equiv="Refresh" content="0; url=http://q.org/%C3?b=2">', 12: link("/relative"), 7: link("http://z.net/fr/1"), 9: None}
    rows = [(i, u, html.get(i, "<p>"), "c", "n") for i, u in URLS] + [(i, f"http://h{i}.org/", link(f"http://h{i + 1}.org"), "c", "n") for i in range(30, 60)] + [(60, "http://h60.org", link("http://e.net/fr/9?a=1&amp;b=2"), "c", "n")]
    rows += [(70, "http://i1.org/", link("http://i2.org/"), "", ""), (71, "http://i2.org", link("http://d.net/es/"), "", ""), (72, "http://i3.org", link("http://i2.org"), "", ""), (73, "http://i4.com/", link("http://i3.org"), "", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string, component string, node string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op6_url_filter(spark, str(tmp_path))
    assert collected(got) == by_duckdb(tmp_path, sql.URL_FILTER, "pages")
    verdict = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert verdict[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert verdict[2][2:] == ("www.example.com/en/", "allow") and verdict[17][2:] == ("www.example.com/en/", "allow")
    assert verdict[4][2:] == (None, "block") and verdict[5][2:] == ("net/fr/", "block")
    assert verdict[6] == verdict[7] == verdict[8] == ("", "", None, "allow")
    assert verdict[9][2:] == ("com/", "allow") and verdict[10] == ("example.com", "", None, "allow")
    assert verdict[14][2:] == (None, "block")
    assert all(verdict[i][3] == "block" for i in range(30, 61))
    assert [verdict[i][3] for i in (70, 71, 72, 73)] == ["allow"] * 4  # the allowed i4.com is an alias


def test_redirects_carry_blocks_and_allow_wins(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", None), (2, "http://b.org/", None)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://a.org", "http://x.org/r"), ("http://x.org/r", "https://y.net/fr/"), ("http://b.org/", "http://y2.net/fr/"), ("http://b.org/", "http://k.com/")], "url string, target string")
    got = {r.page_id: r.verdict for r in url_filter.judge(spark, pages, RULES, redirects).collect()}
    assert got == {1: "block", 2: "allow"}


def test_relative_targets_and_all_tags_are_edges(spark):
    two = link("http://other.org/x") + link("http://y.net/fr/2") + '<meta http-equiv=refresh content="0; url=http://o.org"><meta http-equiv=refresh content="0; url=//z.net/es/3">'
    rows = [(1, "http://a.net/en/p/1.html", link("/fr/1.html")), (2, "http://a.net/fa/q/2", link("../../es/2?a=1&amp;b=2")), (3, "http://b.org/", link("//y.net/fr/1")), (4, "http://c.org", two), (5, "http://d.org/", '<meta http-equiv=refresh content="0; URL=//z.net/es/3">')]
    rows += [(6, "http://e.org/", '<base href="//w.net/es/"><link rel=canonical href="k">'), (7, "http://f.org/", link("mailto:x@y.net/fr/") + link("#top")), (8, "none", link("/fr/1")), (9, "http://g.org/", link("/r?to=http://y.net/fr/")), (10, "http://z.com", link("http://q.org/a")), (11, "http://q.org/b/", link("../a")), (12, "http://q.org/c", link("http://s.net/fr/") + link("a"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://h.net/", "/fr/1"), ("http://i.org/x", "http://h.net/")], "url string, target string")
    got = {r.page_id: (r.verdict, r.component) for r in url_filter.judge(spark, pages, RULES, redirects).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["block"] * 6
    assert [got[i][0] for i in range(7, 10)] == ["allow"] * 3
    assert got[10][1] == got[11][1] == got[12][1]


@pytest.mark.parametrize("to, want", [("g", "/b/c/g"), ("./g/", "/b/c/g/"), ("/g", "/g"), ("?y", "/b/c/d;p?y"), ("g?y#s", "/b/c/g?y#s"), (".", "/b/c/"), ("..", "/b/"), ("../..", "/"), ("../../../g", "/g"), ("/./g", "/g"), ("g;x=1/../y", "/b/c/y"), ("g?y/../x", "/b/c/g?y/../x")])
def test_targets_resolve_as_in_rfc_3986(spark, to, want):
    row = spark.createDataFrame([(to, "http://a/b/c/d;p?q")], "t string, u string")
    assert row.select(url_filter.resolved(F.col("t"), F.col("u"))).first()[0] == "http://a" + want


def test_op6_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op6_url_filter(spark, str(tmp_path)).count() == 0


def test_op7_against_sql_and_targets(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1) * 5 % 3000)) + "\x0b", rng.choice(["a", "b", "é", "zz", "", None, "a", "a", "a"]), "z") for i in range(3000)]
    rows += [(i, "one two", "hot", "z") for i in range(5000, 9000)] + [(9001, None, "empty", "z"), (9002, "", "empty", "z"), (None, "x y", "a", "z"), (7, "x", "a", "z"), (7, "x", "a", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, key string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_mixing(spark, str(tmp_path))
    assert collected(got) == by_duckdb(tmp_path, sql.MIXING, "documents")
    taken, target, total = defaultdict(int), {}, 0
    source = {r[0]: r[2] for r in rows}
    for r in got.collect():
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = (r.target, r.source_size)
        total += r.size
    assert sum(t for t, _ in target.values()) == pytest.approx(total)
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted((s for s in target if s is not None)))} | {None: 1 + (len(target) - 1) % 3}
    free = {s: t / weights[s] for s, (t, n) in target.items() if t < 3 * n}
    assert max(free.values()) == pytest.approx(min(free.values()))
    assert all(t / weights[s] <= max(free.values()) * 1.000001 for s, (t, n) in target.items())
    assert all(abs(taken[s] - t) <= 3000 for s, (t, n) in target.items())


def test_mixed_repeats_rows_with_all_columns(spark):
    rows = [(i, "a b c", "s", i * 2) for i in range(40)] + [(50, "x", "t", 1), (50, "x", "t", 1), (None, "y y", "t", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long")
    want = mixing.mix(spark, df).agg(F.sum("copies")).first()[0]
    got = mixing.mixed(spark, df)
    assert got.columns == df.columns and got.count() == want
    per = mixing.mix(spark, df).where("doc_id < 40").collect()
    assert {r.doc_id: r.copies for r in per if r.copies} == {r.doc_id: r["count"] for r in got.where("doc_id < 40").groupBy("doc_id").count().collect()}


def test_op7_empty_and_all_null(spark, tmp_path):
    schema = "doc_id long, text string, source string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert op7_mixing(spark, f"{tmp_path}/a").count() == 0
    spark.createDataFrame([(None, None, None)], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op7_mixing(spark, f"{tmp_path}/b").collect() == [(None, 0, 0, 0.0, 0)]


def test_long_lists_of_rules_are_joined(spark, monkeypatch):
    rng = random.Random(4)
    part = lambda: rng.choice(["a", "b", "example", "x-y", "com"])
    rules = [(rng.choice(["allow", "block"]), ".".join(part() for _ in range(rng.randint(1, 3))), "/" + rng.choice(["", "a/", "en/", "en/b"])) for _ in range(120)]
    pages = [(i, f"http://{'.'.join(part() for _ in range(rng.randint(1, 4)))}/{rng.choice(['', 'a/', 'en/', 'en/b/c', 'z'])}", None) for i in range(400)] + [(900, None, None), (901, "no address", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    answer = lambda: sorted(map(tuple, url_filter.judge(spark, df, rules).select("page_id", "host", "path", "rule", "verdict").collect()))
    want = answer()
    assert {r[4] for r in want} == {"allow", "block"} and len(want) == len(pages)
    monkeypatch.setattr(url_filter, "EXPRESSION_RULES", 3)
    assert answer() == want
    monkeypatch.undo()
    rules = [(f"{v}", f"h{k}.net", "/") for k in range(3000) for v in ("block", "allow") if v == "block" or k % 2]
    df = spark.createDataFrame([(k, f"https://www.H{k}.net/p", None) for k in (0, 1, 2999, 3000)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.verdict, r.rule) for r in url_filter.judge(spark, df, rules).collect()) == [(0, "block", "h0.net/"), (1, "allow", "h1.net/"), (2999, "allow", "h2999.net/"), (3000, "allow", None)]


def test_mixed_keeps_columns_with_dots(spark):
    rows = [(i % 7, "a b c", "s") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("x.y", F.lit(1))
    assert mixing.mixed(spark, docs).columns == ["doc_id", "text", "source", "x.y"]
