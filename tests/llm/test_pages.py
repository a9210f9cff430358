import html
import re

import numpy as np
import pytest

from lodestone.llm import boosting, page_samples, pages
from lodestone.llm.queries import op10_html_text


@pytest.fixture(scope="module")
def trees():
    return pages.model()


def by_pattern(page):
    """What the tables' pages hold between <article> and </article>."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(p for p in parts if p)


def test_boosting_fits_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(float)
    model = boosting.fit(x[:3000], y[:3000], trees=40)
    assert ((model.logits(x[3000:]) > 0) == y[3000:]).mean() > 0.97


def test_op10_on_the_tables(spark):
    d = "/root/testdata/sf0.1"
    want = {r.page_id: (r.url, by_pattern(r.html)) for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = op10_html_text(spark, d).collect()
    assert len(rows) == len(want)
    assert all(r.n_chars == len(r.text) and r.url == want[r.page_id][0] for r in rows)
    assert sum(r.text == want[r.page_id][1] for r in rows) == len(want)


def test_generated_pages_that_were_not_fitted(trees):
    blocks = wrong = 0
    for page in page_samples.pages(150, seed=5):
        dom = pages.parse(page)
        x, found = pages.features(dom)
        kept = pages.decode(dom, trees.logits(x))
        for node, _ in found:
            up = node
            while up >= 0 and dom.mark[up] is None:
                up = dom.parent[up]
            blocks += 1
            wrong += kept[node] != (up >= 0 and dom.mark[up] == "1")
    assert wrong <= 0.015 * blocks


PARTS = [
    '<header><h1>Site name</h1><p>We write daily.</p></header>', '<nav><a href="/">Home</a> <a href="/n">News</a></nav>', '<aside><h3>Popular</h3><a href="/a">Other story here</a></aside>', '<div class="sidebar"><p>About the author of this site.</p></div>',
    '<div class="cookie-notice"><p>We use cookies. Accept them.</p></div>', '<div class="advert">Buy now, everything must go.</div>', '<form><label>Mail</label><input name="m"><button>Send</button></form>', '<section id="comments"><h2>3 comments</h2><p>I do not agree with this at all.</p></section>',
    '<footer>&copy; 2020 somebody</footer>', "<script>document.write('<p>no</p>')</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", '<div class="comment-list"><div class="comment"><p>Nice text, thank you very much.</p></div></div>',
]


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("first", [True, False])
def test_other_parts_are_left_out(trees, part, first):
    article = "<article><h1>A headline of words</h1><p>First of the paragraphs, with an &eacute; and <b>bold</b> words in it.</p><p>Short.</p><p>The last one, which is\n  somewhat longer than the others are.</p></article>"
    page = f"<html><head><title>x</title></head><body>{part if first else ''}{article}{'' if first else part}</body></html>"
    want = "A headline of words\n\nFirst of the paragraphs, with an é and bold words in it.\n\nShort.\n\nThe last one, which is somewhat longer than the others are."
    assert pages.main_texts([page], trees) == [want]


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title><body>{}</body></html>", "<html><head><meta charset=utf-8><title>x</title>{}", "<head><head><title>x</title><body>{}", "<head><title>x</title><script>1</script><noscript><style>p</style></noscript><body>{}",
        "<head><title>x</title></head><body><select><option>a<input>{}", "<head><title>x</title></head><body><button>a<button>b</button>{}",
    ],
)
def test_omitted_end_tags_silence_nothing(trees, page):
    article = "<article><h1>A headline of words</h1><p>First of the paragraphs, with some words in it.</p><p>The last one, which is somewhat longer than the others are.</p></article>"
    want = "A headline of words\n\nFirst of the paragraphs, with some words in it.\n\nThe last one, which is somewhat longer than the others are."
    assert pages.main_texts([page.format(article)], trees) == [want]


def test_text_ends_a_head():
    said = lambda page: ["".join(words).strip() for _, words in pages.parse(page).runs]
    assert said("<head><title>x</title>\n some words") == ["some words"]
    assert [s for s in said("<head><title>x</title>\n</head>\n<p>a</p>") if s] == ["a"]


def test_choices_never_contradict(trees):
    for page in page_samples.pages(30, seed=6):
        dom = pages.parse(page)
        kept = pages.decode(dom, np.random.default_rng(1).normal(size=len(dom.tag)) * 3)
        assert all(kept[dom.parent[k]] for k in range(1, len(kept)) if kept[k])


def test_decoding_is_the_likeliest_choice():
    import itertools

    dom = pages.parse("<div><p>a</p><ul><li>b</li><li>c</li></ul></div><p>d</p>")
    z = np.random.default_rng(2).normal(size=len(dom.tag)) * 2
    p = 1 / (1 + np.exp(-z))
    best = max((c for c in itertools.product((False, True), repeat=len(z)) if all(c[dom.parent[k]] or not c[k] for k in range(1, len(c)))), key=lambda c: np.log(np.where(c, p, 1 - p)).sum())
    assert pages.decode(dom, z) == list(best)


def test_odd_rows(spark):
    rows = [(1, None, "u", "old"), (2, "", "u", "old"), (3, "<", None, "old"), (4, "<article><p>" + "word " * 50000 + "</p></article>", "u", "x"), (None, "<p>unclosed <b>a", "u", "x"), (5, "<div>" * 3000 + "deep text in there", "u", "x"), (5, "</p></div>&#0;&bogus;", "u", "x")]
    got = pages.extract(spark, spark.createDataFrame(rows, "page_id long, html string, url string, text string"))
    assert got.columns == ["page_id", "html", "url", "text", "n_chars"]
    found = {(r.page_id, r.html): r.text for r in got.collect()}
    assert len(found) == len(rows) and found[1, None] == found[2, ""] == ""
    assert found[4, rows[3][1]] == ("word " * 50000).strip()
    assert pages.extract(spark, spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_formulas_and_fallbacks_are_text(trees):
    first = "First of the paragraphs, with some words in it, and here <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='t'>no</annotation></math> stands for a number."
    page = f"<article><h1>A headline of words</h1><p>{first}</p><p>The last one, <object data='a.swf'>a film of it</object> is somewhat longer than the others are.</p></article>"
    want = "A headline of words\n\nFirst of the paragraphs, with some words in it, and here x=2 stands for a number.\n\nThe last one, a film of it is somewhat longer than the others are."
    assert pages.main_texts([page], trees) == [want]


def test_silent_elements_amid_a_paragraph_do_not_part_it(trees):
    page = "<article><h1>A headline of words</h1><p>First of the paragraphs<script>var x = 1;</script>, with a <svg><text>no</text></svg> picture<noscript><p>no</p></noscript> in it.</p><p>The last one, which is somewhat longer than the others are.</p></article>"
    want = "A headline of words\n\nFirst of the paragraphs, with a picture in it.\n\nThe last one, which is somewhat longer than the others are."
    assert pages.main_texts([page], trees) == [want]


@pytest.mark.parametrize("start, end", [("<b>", "</i>"), ("<i><p>", ""), ("<i>", "<p></b>"), ("<b>", "</b></i>"), ("<li>", "</p>"), ("<p><b>", "</a>")])
def test_broken_pages_take_linear_work(start, end):
    class Counted(pages.Dom):
        steps = 0

        def _push(self, tag, node):
            self.steps += 1
            super()._push(tag, node)

        def _pop(self):
            self.steps += 1
            super()._pop()

        def _last(self, tags):
            self.steps += len(tags)
            return super()._last(tags)

    def steps(n):
        dom = Counted()
        dom.feed("<i><div>" + start * n + end * n)
        dom.close()
        return dom.steps

    assert steps(8000) <= 4.1 * steps(2000)


def test_a_long_page_is_judged_in_parts(trees, monkeypatch):
    page = "<body><nav class='menu'>" + "<a href='/'>go</a>" * 20 + "</nav><article>" + "".join(f"<p>Paragraph {i} of the text, which has some words, and a few more of them.</p>" for i in range(900)) + "</article></body>"
    want = pages.main_texts([page], trees)
    assert want[0].count("\n\n") == 899
    made = []
    monkeypatch.setattr(pages, "NODES", 64)
    rows = pages.Nodes.rows
    monkeypatch.setattr(pages.Nodes, "rows", lambda self, lo, hi: made.append(rows(self, lo, hi)) or made[-1])
    assert pages.main_texts([page], trees) == want and max(map(len, made)) == 64


def test_slices_by_nodes_change_nothing(trees, monkeypatch):
    some = [*page_samples.pages(12, seed=9), None, "", "<p>a</p>"]
    want = pages.main_texts(some, trees)
    monkeypatch.setattr(pages, "NODES", 40)
    assert pages.main_texts(some, trees) == want


# Pages written by hand, shaped as common publishing systems shape them; what is kept of each stands after it.
BY_HAND = [
    (
        """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Tide tables - The Harbour Blog</title><link rel="stylesheet" href="s.css"></head>
<body class="post-template-default single single-post postid-12"><div id="page" class="site"><a class="skip-link" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><p class="site-title"><a href="/">The Harbour Blog</a></p><nav id="site-navigation"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li><li><a href="/contact">Contact</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main"><article id="post-12" class="post hentry"><div class="entry-content"><p>Tide tables are printed a year ahead, because the pull of moon and sun can be worked out long before it is felt.</p>
<p>What they cannot tell is the wind, which may hold the water back for hours &mdash; or push it over the quay.</p><h2>Reading a table</h2><p>Each day has two high waters and two low ones, most of the time.</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Thanks, this helped me a lot with my boat.</p></li><li class="comment"><p>Mine says three?</p></li></ol></div></main>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Knots</a></li><li><a href="/2">Ropes</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by a publishing system</div></footer></div></body></html>""",
        ["Tide tables are printed", "What they cannot tell", "Each day has two high"], ["Skip to", "Contact", "Thanks, this", "Knots", "Proudly", "Mine says"],
    ),
    (
        """<html><body><table width="100%"><tr><td colspan="2" class="banner"><a href="/">City Archive</a></td></tr><tr><td class="sidebar" width="150"><a href="/a">Maps</a><br><a href="/b">Letters</a><br><a href="/c">Photographs</a></td>
<td class="content"><p>The oldest letter in the archive was written by a miller who complained about the price of grain and the state of the bridge.</p><p>He asked the council to mend it before the winter, and promised two sacks of flour for the workmen.</p>
<blockquote>It shakes so that the horse will not go over it.</blockquote><p>The bridge was mended in the spring, as the accounts of that year show.</p></td></tr><tr><td colspan="2" class="footer">Copyright City Archive. All rights reserved.</td></tr></table></body></html>""",
        ["The oldest letter", "He asked the council", "It shakes so", "The bridge was mended"], ["Photographs", "Copyright"],
    ),
    (
        """<body><div class="cookie-banner" role="dialog"><p>We value your privacy. Accept all cookies?</p><button>Accept</button></div><div class="navbar"><a href="/">News</a><a href="/s">Sport</a><a href="/w">Weather</a></div>
<div class="story"><div class="share-buttons"><a href="#">Tweet</a><a href="#">Share</a></div><p>A heron has built its nest on the roof of the town library, and the reading room below has been closed until the young have flown.</p><div class="ad-slot">Advertisement: new shoes, half price</div>
<p>The librarian said that readers were welcome to use the hall in the meantime.</p><ul><li>Books may be returned at the side door.</li><li>The hall is open from nine to five.</li></ul></div>
<div class="related-articles"><h3>More like this</h3><a href="/x">Owls in the tower</a><a href="/y">Swans on the pond</a></div><div class="newsletter-signup"><form><label>Your mail</label><input><button>Subscribe</button></form></div></body>""",
        ["A heron has built", "The librarian said", "Books may be returned", "The hall is open"], ["We value", "Weather", "Tweet", "half price", "Owls", "Your mail", "Subscribe"],
    ),
]


@pytest.mark.parametrize("page, kept, gone", BY_HAND)
def test_pages_written_by_hand(trees, page, kept, gone):
    text = pages.main_texts([page], trees)[0]
    assert all(k in text for k in kept), text
    assert not [g for g in gone if g in text], text


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "<article><p>Some words that make a sentence, and more.</p></article>", "old", "x", 5)], "page_id long, html string, text string, n_chars string, url int")
    got = pages.extract(spark, df)
    assert got.columns == ["page_id", "html", "url", "text", "n_chars"] and got.first().n_chars == len(got.first().text) > 0
