"""Main text of web pages: boosted trees over features of DOM nodes, decoded so that what is kept is a tree."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, page_samples, shared

#: Generated pages that the trees are fitted on.
SAMPLE_PAGES = 1500
#: Pages that are read at a time, and nodes whose features are held at a time.
SLICE, NODES = 200, 50_000

# Kinds of HTML elements, and words in class, id and role that hint at what an element is for.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"head", "script", "style", "noscript", "template", "iframe", "svg", "audio", "video", "canvas", "select", "button", "textarea", "input", "map", "annotation", "annotation-xml"}
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "script", "style", "noscript", "noframes", "template"}
ENDS_SELECT = {"input", "textarea", "select", "caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "object", "math", "semantics", "mrow", "mi", "mo", "mn", "ms", "mtext", "msub", "msup", "msubsup", "mfrac", "msqrt", "mroot", "munder", "mover", "munderover", "mstyle", "mspace", "mpadded", "mfenced", "menclose", "mtable", "mtr", "mtd", "annotation", "annotation-xml"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody"}, "tbody": {"thead", "tbody"}}
HOLDS = {"ul", "ol", "dl", "table", "select", "menu"}
HINTS = {
    "menu": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "tabs", "pagination", "pager", "skip", "sitemap", "toc"},
    "header": {"header", "masthead", "banner", "logo", "branding", "hero", "top"},
    "footer": {"footer", "foot", "copyright", "legal", "colophon", "contentinfo", "bottom"},
    "side": {"sidebar", "side", "aside", "rail", "widget", "widgets", "complementary", "column", "secondary"},
    "ad": {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "adsbygoogle", "dfp", "outbrain", "taboola", "commercial"},
    "notice": {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "message", "disclaimer", "warning"},
    "talk": {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "commentlist", "feedback", "reactions", "review", "reviews"},
    "share": {"share", "sharing", "social", "follow", "twitter", "facebook", "tools", "actions", "buttons", "like"},
    "more": {"related", "recommended", "more", "popular", "trending", "latest", "teaser", "teasers", "tags", "tag", "categories", "archive", "links", "next", "prev", "author", "bio", "meta", "byline"},
    "form": {"form", "search", "login", "register", "contact", "input", "signin", "field"},
    "text": {"article", "content", "main", "post", "entry", "body", "story", "text", "page", "blog", "hentry", "prose", "articlebody"},
}
_HINT = {word: k for k, words in enumerate(HINTS.values()) for word in words}
_TAGS = [{"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset"}, {"article"}, {"main"}, {"section"}, {"div"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "tbody", "thead", "tr"}, {"td", "th"}, {"blockquote", "pre", "figure", "figcaption"}, {"body", "html", "#root"}, {"dialog"}]
_TAG = {tag: k for k, tags in enumerate(_TAGS) for tag in tags}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Dom(HTMLParser):
    """Block elements as nodes, in page order, and runs of text with the node that holds them directly."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.hints, self.mark = ["#root"], [()], [None]
        self.parent, self.depth, self.links, self.hidden = array("q", [-1]), array("l", [0]), array("q", [0]), bytearray([0])
        self.runs: list[tuple[int, list[str]]] = []
        self.stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the node that holds their text
        self.open: dict[str, list[int]] = {}  # places in the stack by tag, and those of what isn't inline
        self.blocks: list[int] = [0]
        self.silent, self.link, self.fresh = 0, 0, True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if self.silent and tag in ENDS_SELECT:
            self._close({"select"}, SILENT - {"select"})
        if self.silent and tag == "button":
            self._close({"button"}, SILENT - {"button"})
        if tag == "br":
            self._say(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.fresh = True
            return
        if tag in CLOSES_P:
            self._close({"p"}, HOLDS | SILENT | {"td", "th", "div", "article", "section", "body", "li"})
        if tag in SAME:
            self._close(SAME[tag], SILENT - {"select"} | (HOLDS - {"table"} if tag in ("li", "dt", "dd") else {"table"}))
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag in SILENT or self.silent:
            self._push(tag, self.stack[-1][1])
            self.silent += tag in SILENT
            return
        words, hidden, mark = [], False, None
        for name, value in attrs:
            if name in ("class", "id", "role"):
                words += [w.lower() for w in _WORD.findall(value or "")]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
                hidden = True
            elif name == page_samples.MARK:
                mark = value
        hints = tuple({_HINT[w] for w in words if w in _HINT})
        self.link += tag == "a"
        apart = "skip" in words if tag == "a" else bool(hints)
        if tag in INLINE and not apart and not hidden:
            self._push(tag, self.stack[-1][1])
            return
        up = self.stack[-1][1]
        self.tag.append(tag)
        self.parent.append(up)
        self.hints.append(hints)
        self.hidden.append(hidden)
        self.mark.append(mark)
        self.depth.append(self.depth[up] + 1)
        self.links.append(0)
        self._push(tag, len(self.tag) - 1)
        self.fresh = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: only void elements close themselves

    def _push(self, tag: str, node: int) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def _pop(self) -> None:
        tag, _ = self.stack.pop()
        self.open[tag].pop()
        self.silent -= tag in SILENT and self.silent > 0
        self.link -= tag == "a" and self.link > 0
        if tag not in INLINE:
            self.blocks.pop()
            self.fresh |= tag not in SILENT and not self.silent  # a script or picture amid a text doesn't part it

    def _last(self, tags: set[str]) -> int:
        """Place of the innermost open element of tags, 0 if there is none."""
        return max((places[-1] for t in tags if (places := self.open.get(t))), default=0)

    def _close(self, tags: set[str], until: set[str]) -> None:
        """Closes the nearest of tags, unless one of until is open within it."""
        if (k := self._last(tags)) and k > self._last(until - tags):
            while len(self.stack) > k:
                self._pop()

    def _end_head(self) -> None:
        """What can't be in a head ends one whose end tag is left out."""
        while self.stack[-1][0] == "head":
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body"):
            return
        # an inline end tag closes nothing beyond the block it stands in
        k = self._last({tag})
        if k and (tag not in INLINE or k > self.blocks[-1]):
            while len(self.stack) > k:
                self._pop()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        self._say(data)

    def _say(self, data: str) -> None:
        if self.silent:
            return
        node = self.stack[-1][1]
        if self.fresh or not self.runs or self.runs[-1][0] != node:
            self.runs.append((node, []))
            self.fresh = False
        self.runs[-1][1].append(data)
        if self.link:
            self.links[node] += len(data)


def parse(html: str | None) -> Dom:
    dom = Dom()
    dom.feed(html or "")
    dom.close()
    return dom


class Nodes:
    """What the features of a page's nodes are made of: a few numbers and bits a node. rows() makes the features of some."""

    def __init__(self, dom: Dom, blocks: list[tuple[int, str]]):
        n = len(dom.tag)
        own, marks, count = np.zeros(n), np.zeros(n), np.zeros(n)
        before, at = np.full(n, -1.0), 0
        for node, text in blocks:
            own[node] += len(text)
            marks[node] += text.count(".") + text.count(",")
            count[node] += 1
            up = node
            while up >= 0 and before[up] < 0:
                before[up], up = at, dom.parent[up]
            at += len(text)
        self.parent, self.own, self.before = np.array(dom.parent, np.int64), own, np.maximum(before, 0)
        self.depth, self.hidden = np.array(dom.depth, np.int32), np.array(dom.hidden, bool)
        # sums over subtrees: a node's parent stands before it
        sums = [own.copy(), np.minimum(np.array(dom.links, float), own), marks, count, np.ones(n), np.array([t == "p" for t in dom.tag], float)]
        total, total_links, total_marks, total_count, tags, paragraphs = sums
        self.children, self.nth = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for k in range(n - 1, 0, -1):
            p = dom.parent[k]
            total[p] += total[k]
            total_links[p] += total_links[k]
            total_marks[p] += total_marks[k]
            total_count[p] += total_count[k]
            tags[p] += tags[k]
            paragraphs[p] += paragraphs[k]
        self.total, self.total_links, self.total_marks, self.total_count, self.tags, self.paragraphs = sums
        self.hint, self.above, self.tag, self.tag_above = (np.zeros(n, np.int32) for _ in range(4))
        for k in range(n):
            self.hint[k] = sum(1 << h for h in set(dom.hints[k]))
            self.tag[k] = 1 << t if (t := _TAG.get(dom.tag[k])) is not None else 0
            if k:
                p = dom.parent[k]
                self.nth[k] = self.children[p]
                self.children[p] += 1
                self.above[k] = self.above[p] | self.hint[p]
                self.tag_above[k] = self.tag_above[p] | self.tag[p]

    def __len__(self) -> int:
        return len(self.parent)

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """Features of the nodes from lo up to hi."""
        s = slice(lo, min(hi, len(self)))
        up = np.maximum(self.parent[s], 0)
        siblings, page, total = self.children[up].astype(float), max(self.total[0], 1.0), self.total[s]
        ratio = lambda a, b: a / np.maximum(b, 1.0)
        bits = lambda flags, count: (flags[s, None] >> np.arange(count, dtype=np.int32) & 1).astype(float)
        plain = np.column_stack([
            self.depth[s], self.children[s], siblings, self.nth[s], ratio(self.nth[s], siblings), np.log1p(total), np.log1p(self.own[s]), ratio(self.total_links[s], total), ratio(total, self.tags[s]),
            ratio(self.total_marks[s], total), ratio(total, self.total[up]), ratio(total, page), self.paragraphs[s], ratio(total, self.total_count[s]), ratio(self.before[s], page), self.hidden[s].astype(float),
        ])
        return np.concatenate([plain, bits(self.hint, len(HINTS)), bits(self.above, len(HINTS)), bits(self.tag, len(_TAGS)), bits(self.tag_above, len(_TAGS))], axis=1)


def nodes_of(dom: Dom) -> tuple[Nodes, list[tuple[int, str]]]:
    """What a page's features are made of, and the blocks of text: (node, text), white space made one space."""
    blocks = [(node, text) for node, run in dom.runs if (text := " ".join("".join(run).split()))]
    return Nodes(dom, blocks), blocks


def features(dom: Dom) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """One row of features for each node, and the blocks of text."""
    nodes, blocks = nodes_of(dom)
    return nodes.rows(0, len(nodes)), blocks


@functools.cache
def model(pages: int = SAMPLE_PAGES) -> boosting.Boosted:
    """Fitted on generated pages, whose nodes are labelled as they are made: 1 if they hold or lead to main text."""
    x, y = [], []
    for html in page_samples.pages(pages):
        dom = parse(html)
        rows, blocks = features(dom)
        good = np.zeros(len(dom.tag))
        for node, _ in blocks:
            up = node
            while up >= 0 and dom.mark[up] is None:
                up = dom.parent[up]
            if up >= 0 and dom.mark[up] == "1":
                while node >= 0 and not good[node]:
                    good[node], node = 1, dom.parent[node]
        x.append(rows)
        y.append(good)
    return boosting.fit(np.concatenate(x), np.concatenate(y))


def decode(dom: Dom, logits: np.ndarray) -> list[bool]:
    """The likeliest choice in which a node is kept only if its parent is: a subtree is kept or dropped as a whole or cut
    further down, whichever has the greater likelihood."""
    n = len(dom.tag)
    keep, drop = (-np.logaddexp(0, -logits)).tolist(), (-np.logaddexp(0, logits)).tolist()
    for k in range(n - 1, 0, -1):
        keep[dom.parent[k]] += max(keep[k], drop[k])
        drop[dom.parent[k]] += drop[k]
    kept = [keep[0] >= drop[0]]
    for k in range(1, n):
        kept.append(kept[dom.parent[k]] and keep[k] > drop[k])
    return kept


def main_texts(htmls: list[str | None], trees: boosting.Boosted) -> list[str]:
    """Main texts of pages. The features of NODES nodes are held at a time, of several pages or of a part of one."""
    out, waiting, nodes = [], [], 0

    def judge() -> None:
        if waiting:
            sizes = [len(x) for _, x, _ in waiting]
            some = waiting[0][1] if len(waiting) == 1 else None
            if some is not None:
                logits = [np.concatenate([trees.logits(some.rows(lo, lo + NODES)) for lo in range(0, len(some), NODES)])]
            else:
                logits = np.split(trees.logits(np.concatenate([x.rows(0, len(x)) for _, x, _ in waiting])), np.cumsum(sizes)[:-1])
            for (dom, _, blocks), z in zip(waiting, logits, strict=True):
                kept = decode(dom, z)
                out.append("\n\n".join(text for node, text in blocks if kept[node]))
            waiting.clear()

    for html in htmls:
        dom = parse(html)
        if nodes + len(dom.tag) > NODES:
            judge()
            nodes = 0
        waiting.append((dom, *nodes_of(dom)))
        nodes += len(dom.tag)
    judge()
    return out


def extract(spark: SparkSession, pages: DataFrame, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars", keep_html: bool = True) -> DataFrame:
    """pages with text, the main text, and n_chars, its number of characters (code points).

    Blocks of text stand in page order, joined by two line feeds; within a block white space is one space. Every row
    keeps its columns, the html only with keep_html; ones of the new names are replaced. Null or empty html gives an empty text; broken markup is read
    as browsers would, about; an empty table gives an empty result. The trees are fitted on the driver, once, and sent
    to the executors; they are a few kilobytes.
    """
    trees = spark.sparkContext.broadcast(model())
    kept = pages.drop(text_col, chars_col)
    names = [c for c in kept.columns if keep_html or c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shared.worker("pages"):
            for batch in batches:
                for part in shared.parts(batch, html_col, SLICE):
                    texts = main_texts(part.column(html_col).to_pylist(), trees.value)
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, text_col, chars_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names), f"`{text_col}` string", f"`{chars_col}` long"])
    return kept.mapInArrow(run, schema)
