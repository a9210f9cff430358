"""Generated web pages with labelled elements, to fit page extraction on."""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Attribute that labels an element and what is in it: 1 for main text, 0 for anything else.
MARK = "data-sample-label"

_SYLLABLES = "ba be bi bo bu da de di do du fa fe fi fo ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no ra re ri ro sa se si so su ta te ti to tu va ve vi za zo".split()
_LABELS = "Home About News Contact Search Login Help Shop Blog Products Services Terms Privacy Imprint Archive Forum Jobs Events".split()


def _word(r: random.Random) -> str:
    return "".join(r.choices(_SYLLABLES, k=r.choice((1, 2, 2, 3, 3, 4))))


def _sentence(r: random.Random, most: int = 20) -> str:
    words = [_word(r) for _ in range(r.randint(1, most))]
    if r.random() < 0.3 and len(words) > 4:
        words[len(words) // 2] += ","
    return " ".join(words).capitalize() + r.choice([".", ".", ".", "?", "!", ""])


def _prose(r: random.Random, sentences: int) -> str:
    text = " ".join(_sentence(r) for _ in range(r.randint(1, sentences)))
    style = r.random()
    if style < 0.05:
        return text.upper()
    if style < 0.1:
        return text.replace(" ", " | ")
    if style < 0.25:
        words = text.split(" ")
        k = r.randrange(len(words))
        words[k] = r.choice(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<b>{}<br>", "<span>{}</span>"]).format(words[k])
        return " ".join(words)
    return text


def _links(r: random.Random, n: int) -> str:
    items = [f'<a href="/{_word(r)}">{r.choice(_LABELS) if r.random() < 0.6 else _word(r)}</a>' for _ in range(n)]
    if r.random() < 0.6:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return r.choice([" | ", " ", " &middot; "]).join(items)


def _marked(tag: str, label: int, body: str, names: str | None = None, r: random.Random | None = None) -> str:
    name = f' {r.choice(("class", "id", "class"))}="{names}"' if names and r else ""
    return f'<{tag}{name} {MARK}="{label}">{body}</{tag}>'


def _junk(r: random.Random, kind: str) -> str:
    """An element that isn't main text. Most say what they are by tag or name; kinds that are plain otherwise always do."""
    pick, prefix = r.choice, r.choice(["", "", "site-", "page ", "block-", "js-"])
    if kind == "menu":
        return pick([lambda: _marked("nav", 0, _links(r, r.randint(2, 14)), pick([None, "main"]), r), lambda: _marked("div", 0, _links(r, r.randint(3, 14)), prefix + pick(["nav", "menu", "navigation", "breadcrumb", "topbar", "pagination"]), r), lambda: _marked("ul", 0, "".join(f'<li><a href="/">{pick(_LABELS)}</a></li>' for _ in range(r.randint(3, 9))), pick(["menu", None, "nav"]), r)])()
    if kind == "header":
        body = f"<h1>{_sentence(r, 3)}</h1><p>{_sentence(r, 8)}</p>" if r.random() < 0.5 else f"<a href='/'>{_word(r)}</a> {_links(r, 4)}"
        return _marked("header", 0, body, pick([None, "header", "masthead"]), r) if r.random() < 0.6 else _marked("div", 0, body, prefix + pick(["header", "masthead", "banner", "logo"]), r)
    if kind == "footer":
        body = pick([f"&copy; {_word(r)}.example &middot; {_prose(r, 2)}", f"<p>{_prose(r, 2)}</p>{_links(r, 4)}", _prose(r, 2)])
        return _marked("footer", 0, body, pick([None, "footer"]), r) if r.random() < 0.6 else _marked("div", 0, body, prefix + pick(["footer", "copyright", "legal", "colophon"]), r)
    if kind == "side":
        body = f"<h3>{_sentence(r, 3)}</h3>" + pick([_links(r, r.randint(2, 8)), f"<p>{_prose(r, 3)}</p>", f"<div><p>{_prose(r, 2)}</p><p>{_prose(r, 2)}</p></div>"])
        return _marked("aside", 0, body, pick([None, "sidebar"]), r) if r.random() < 0.5 else _marked("div", 0, body, prefix + pick(["sidebar", "side", "widget", "rail", "secondary"]), r)
    if kind == "ad":
        body = pick([_prose(r, 2), f"<p>{_prose(r, 3)}</p>", f'<a href="/buy">{_sentence(r)}</a>', f"<div><span>{_sentence(r)}</span></div>"])
        return _marked(pick(["div", "div", "aside", "section", "p"]), 0, body, prefix + pick(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "adsense"]), r)
    if kind == "notice":
        body = pick([_prose(r, 3), f"<p>{_prose(r, 3)}</p><button>OK</button>", f"<h2>{_sentence(r, 4)}</h2><p>{_prose(r, 2)}</p>"])
        return _marked(pick(["div", "div", "section", "p", "dialog"]), 0, body, prefix + pick(["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall"]), r)
    if kind == "talk":
        one = lambda: pick([f'<div class="comment"><b>{_word(r)}</b><p>{_prose(r, 4)}</p></div>', f"<li><p>{_prose(r, 4)}</p><a href='#'>Reply</a></li>", f"<article class='comment'><p>{_prose(r, 4)}</p></article>"])
        body = f"<h3>{r.randint(1, 40)} {pick(['Comments', 'Replies', 'Kommentare'])}</h3>" + "".join(one() for _ in range(r.randint(1, 8)))
        return _marked(pick(["div", "section", "ol", "aside"]), 0, body, prefix + pick(["comments", "comment-list", "discussion", "replies", "disqus", "reader-comments"]), r)
    if kind == "share":
        return _marked(pick(["div", "ul", "p"]), 0, _links(r, r.randint(2, 5)) if r.random() < 0.7 else _sentence(r, 6), prefix + pick(["share", "social", "sharing", "follow", "share-buttons"]), r)
    if kind == "more":
        return _marked(pick(["div", "section", "aside"]), 0, f"<h2>{_sentence(r, 3)}</h2>{_links(r, r.randint(2, 7))}" if r.random() < 0.7 else f"<p><a href='/m'>{_sentence(r)}</a></p><p>{_prose(r, 1)}</p>", prefix + pick(["related", "more", "recommended", "popular", "tags", "teasers", "author-bio"]), r)
    if kind == "form":
        return f'<form {MARK}="0">{pick([f"<label>{_word(r)}</label><input name=q><button>{_word(r)}</button>", f"<p>{_prose(r, 2)}</p><input><select><option>{_word(r)}</select>", f"<fieldset><legend>{_word(r)}</legend>{_sentence(r)}</fieldset>"])}</form>'
    return f'<div hidden {MARK}="0"><p>{_prose(r, 3)}</p></div>' if r.random() < 0.5 else f'<div style="display: none" {MARK}="0">{_prose(r, 3)}</div>'


_KINDS = ["menu", "header", "footer", "side", "ad", "notice", "talk", "share", "more", "form", "hidden"]


def _main(r: random.Random) -> str:
    """The blocks of an article, with other things among them at times."""
    body = [f"<{h}>{_sentence(r, 12)}</{h}>" for h in [r.choice(["h1", "h1", "h2"])] if r.random() < 0.85]
    for _ in range(r.choice((1, 1, 2, 3, 5, 8, 13, 20))):
        x = r.random()
        if x < 0.75:
            body.append(f"<p>{_prose(r, r.choice((1, 1, 3, 6)))}" + r.choice(["</p>", "</p>", "</p>", ""]))
        elif x < 0.8:
            body.append(f"<h3>{_sentence(r, 6)}</h3>")
        elif x < 0.85:
            tag = r.choice(["ul", "ol"])
            body.append(f"<{tag}>" + "".join(f"<li>{_prose(r, 2)}</li>" for _ in range(r.randint(1, 6))) + f"</{tag}>")
        elif x < 0.89:
            body.append(f"<blockquote><p>{_prose(r, 3)}</p></blockquote>")
        elif x < 0.92:
            body.append("<table>" + "".join("<tr>" + "".join(f"<td>{_word(r)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 5))) + "</table>")
        elif x < 0.94:
            body.append(f"<pre>{_prose(r, 2)}</pre>")
        elif x < 0.96:
            body.append(f"<figure><img src=x><figcaption>{_sentence(r)}</figcaption></figure>")
        else:
            body.append(f"<div>{_prose(r, 3)}</div>")
    for kind in ("ad", "share", "more", "form", "side", "notice", "talk"):
        if r.random() < 0.07:
            body.insert(r.randint(1, len(body)), _junk(r, kind))
    x, inner = r.random(), "".join(body)
    wrapped = f'<div {MARK}="1">{inner}</div>' if r.random() < 0.2 else inner
    if x < 0.5:
        return _marked("article", 1, wrapped, r.choice([None, None, "post", "story"]), r)
    if x < 0.62:
        return _marked("main", 1, wrapped, r.choice([None, "content"]), r)
    if x < 0.9:
        return _marked(r.choice(["div", "div", "section", "td"]), 1, wrapped, r.choice(["content", "main", "post", "entry-content", "story-body", "article-body", "text", "post-content", "page-content"]), r)
    return _marked("div", 1, wrapped)


def pages(n: int, seed: int = 11) -> Iterator[str]:
    """n pages, the same at every call."""
    r = random.Random(seed)
    for _ in range(n):
        parts = [_main(r)]
        few = r.random() < 0.3
        for kind in _KINDS:
            if r.random() < (0.25 if few else 0.5):
                where = {"header": 0, "menu": 0, "footer": len(parts)}.get(kind, r.randint(0, len(parts)))
                parts.insert(where, _junk(r, kind))
        if r.random() < 0.15:
            parts.insert(0, f'<div {MARK}="0">{_links(r, r.randint(4, 12))}</div>')
        body = "".join(parts)
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            body = f'<div class="{r.choice(["wrapper", "container", "page", "outer", "row"])}">{body}</div>'
        yield f"<!DOCTYPE html><html><head><title>{_sentence(r)}</title><style>p{{}}</style><script>var x='</p>'</script></head><body>{body}</body></html>"
