"""Labelled pages to fit the page model to: random layouts whose article is known.

Elements that are part of the article carry ``data-c=1``, parts within it that aren't carry
``data-c=0``; a node without the attribute has its parent's label. The attribute is only
read for labels, it isn't a feature.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np

from textmill.llm.html_dom import Dom, parse


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.letters = "".join(rng.sample("abcdefghijklmnopqrstuvwxyzàéöñß", 22))

    def word(self) -> str:
        return "".join(self.rng.choice(self.letters) for _ in range(self.rng.choice((1, 2, 2, 3, 4, 5, 6, 8, 11))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 24) -> str:
        comma = ", " if self.rng.random() < 0.4 else " "
        return (self.words(low, high) + comma + self.words(1, 6)).capitalize() + self.rng.choice(("...", ".", ".", ".", "!", "?"))[-1]

    def prose(self, low: int = 1, high: int = 9) -> str:
        return " ".join(self.sentence(1) for _ in range(self.rng.randint(low, high)))

    def inline(self, text: str) -> str:
        if self.rng.random() < 0.25:
            words = text.split(" ")
            k = self.rng.randrange(len(words))
            words[k] = self.rng.choice(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "<code>{}</code>", "&amp; {}")).format(words[k])
            text = " ".join(words)
        return text

    def links(self, low: int = 3, high: int = 9) -> str:
        item = self.rng.choice(('<li><a href="/{0}">{0}</a></li>', '<a href="/{0}">{0}</a> ', '<a href="/{0}">{0}</a> | ', '<span><a href="/{0}">{0}</a></span>'))
        body = "".join(item.format(self.words(1, 3)) for _ in range(self.rng.randint(low, high)))
        return f"<ul>{body}</ul>" if item.startswith("<li") else body

    def wrap(self, kinds: tuple[str, ...], body: str, extra: str = "") -> str:
        """The body in one of the given elements, written as tag or tag.class or tag#id."""
        kind = self.rng.choice(kinds)
        tag, _, cls = kind.replace("#", ".#").partition(".")
        name = f' id="{cls[1:]}"' if cls.startswith("#") else f' class="{cls.replace(".", " ")}"' if cls else ""
        return f"<{tag}{name}{extra}>{body}</{tag}>"


def _advert(w: _Writer) -> str:
    body = w.rng.choice((w.sentence(2, 12), w.prose(1, 3), f"<p>{w.prose(1, 3)}</p>", f'<a href="/buy">{w.words(2, 6)}</a>'))
    return w.wrap(("div.ad", "div.ads", "div.advert", "aside.sponsored", "div.promo", "ins.adsbygoogle", "section.advertisement", "div#ad-top", "p.ad", "div.banner-ad"), body, " data-c=0")


def _notice(w: _Writer) -> str:
    return w.wrap(("div.cookie-notice", "div#consent", "div.notice", "section.alert", "aside.newsletter", "div.modal", "div.popup", "p.notice"), f"<p>{w.prose(1, 3)}</p><button>{w.words(1, 2)}</button>" if w.rng.random() < 0.6 else w.prose(1, 3), " data-c=0")


def _form(w: _Writer) -> str:
    return w.wrap(("form", "form.search", "form#login", "div.subscribe"), f"<label>{w.words(1, 3)}</label><input name=q><p>{w.sentence()}</p><button>{w.words(1, 2)}</button>", " data-c=0")


def _share(w: _Writer) -> str:
    return w.wrap(("div.share", "div.social", "ul.tags", "div.related"), w.links(2, 5), " data-c=0")


def _unseen(w: _Writer) -> str:
    return w.wrap(("div", "p", "section.popup"), w.prose(1, 3), w.rng.choice((" hidden", ' style="display: none"', " style='color:red;visibility:hidden'")) + " data-c=0")


def _control(w: _Writer) -> str:
    return w.rng.choice((f"<textarea data-c=0>{w.words(1, 5)}</textarea>", f"<select data-c=0><option>{w.word()}<option>{w.word()}</select>", f"<button data-c=0>{w.words(1, 2)}</button>"))


def _short_article(w: _Writer) -> str:
    """A word or a sentence or two, with or without a title."""
    r = w.rng
    body = (f"<h1>{w.words(1, 4)}</h1>" if r.random() < 0.3 else "") + "".join(f"<p>{w.inline(r.choice((w.words(1, 2).capitalize() + '.', w.sentence(1, 6))))}</p>" for _ in range(r.choice((1, 1, 2))))
    return w.wrap(("article", "article", "main", "div.content", "div.post"), body + (r.choice((_form, _control, _unseen, _advert))(w) if r.random() < 0.3 else ""), " data-c=1")


def _comments(w: _Writer) -> str:
    one = w.rng.choice(("<div class=comment><b>{1}</b><p>{0}</p></div>", "<li class=comment>{1}: {0}</li>", "<article class=comment><header>{1}</header><p>{0}</p></article>"))
    body = "".join(one.format(w.prose(1, 4), w.word()) for _ in range(w.rng.randint(1, 5)))
    return w.wrap(("section#comments", "div.comments", "ol.comment-list", "div#disqus", "section.discussion"), f"<h3>{w.words(1, 3)}</h3>{body}" + (_form(w) if w.rng.random() < 0.4 else ""), " data-c=0")


def _sidebar(w: _Writer) -> str:
    parts = [f"<h3>{w.words(1, 4)}</h3>", w.links(), f"<p>{w.prose(1, 2)}</p>", w.wrap(("div.widget", "div"), f"<p>{w.prose(1, 3)}</p>")]
    return w.wrap(("aside", "div.sidebar", "div#side", "section.related", "aside.rail", "div.widget"), "".join(w.rng.sample(parts, w.rng.randint(1, 4))))


def _header(w: _Writer) -> str:
    return w.wrap(("header", "div.header", "div#masthead", "div.topbar", "header.site-header"), w.rng.choice((f"<h1>{w.words(1, 3)}</h1>", f'<a href="/">{w.words(1, 3)}</a>', f"<div class=logo>{w.words(1, 2)}</div><p>{w.sentence()}</p>")) + (_menu(w) if w.rng.random() < 0.5 else ""))


def _menu(w: _Writer) -> str:
    return w.wrap(("nav", "div.menu", "div#nav", "ul.navbar", "nav.breadcrumbs"), w.links(*w.rng.choice(((1, 1), (1, 2), (2, 4), (3, 9), (3, 9)))))


def _footer(w: _Writer) -> str:
    body = w.rng.choice((f"&copy; {w.words(1, 2)} &middot; {w.prose(1, 2)}", f"<p>&copy; {w.words(2, 6)}</p>{w.links()}", w.prose(1, 3)))
    return w.wrap(("footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright"), body)


def _article(w: _Writer) -> str:
    r = w.rng
    parts = []
    if r.random() < 0.85:
        title = f"<h1>{w.sentence(2, 9)[: r.choice((60, 200))]}</h1>"
        parts.append(f"<header data-c=1>{title}</header>" if r.random() < 0.15 else title)
    for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
        kind = r.random()
        if kind < 0.62:
            parts.append(f"<p>{w.inline(w.prose())}</p>")
        elif kind < 0.72:
            parts.append(f"<p><b>{w.sentence()}<br><p>{w.prose()}</p>")
        elif kind < 0.78:
            parts.append(f"<h2>{w.words(1, 8)}</h2>")
        elif kind < 0.83:
            parts.append("<ul>" + "".join(f"<li>{w.inline(w.prose(1, 2))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.86:
            parts.append(f"<blockquote>{w.prose()}</blockquote>")
        elif kind < 0.88:
            parts.append(f"<pre>{w.words(3, 30)}</pre>")
        elif kind < 0.91:
            parts.append("<table>" + "".join(f"<tr><td>{w.words(1, 4)}<td>{w.words(1, 3)}</tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif kind < 0.94:
            parts.append(f"<figure><img src=x><figcaption>{w.sentence()}</figcaption></figure>")
        else:
            parts.append(f"<p>{w.words(1, 3)}.</p>")
        if r.random() < 0.12:
            parts.append(r.choice((_advert, _notice, _form, _share, _unseen, _control))(w))
    if r.random() < 0.15:
        parts.append(_comments(w))
    body = "".join(parts)
    if r.random() < 0.2:
        body = f"<div>{body}</div>"
    return w.wrap(("article", "article", "article", "main", "div.content", "div#main", "section.post", "div.entry-content", "div#article", "div", "div.story", "section"), body, " data-c=1")


def labelled_pages(n: int, seed: int) -> Iterator[tuple[Dom, np.ndarray]]:
    """DOMs of random pages and, for each of their nodes, 1 if it is part of the article."""
    for k in range(n):
        w = _Writer(random.Random(seed * 1_000_003 + k))
        r = w.rng
        before = [f(w) for f, p in ((_notice, 0.3), (_header, 0.5), (_menu, 0.7), (_advert, 0.5), (_form, 0.2), (_sidebar, 0.2)) if r.random() < p]
        after = [f(w) for f, p in ((_advert, 0.3), (_share, 0.2), (_comments, 0.35), (_sidebar, 0.35), (_form, 0.2), (_notice, 0.15), (_footer, 0.8)) if r.random() < p]
        if r.random() < 0.7:
            r.shuffle(before)
        short = r.random() < 0.15
        if short and r.random() < 0.5:
            before, after = before[:1] or [_menu(w)], after[-1:]
        middle = _short_article(w) if short else _article(w)
        if r.random() < 0.3:
            middle = w.wrap(("div", "main", "div.page", "div#wrapper", "section"), middle + (after.pop(0) if after and r.random() < 0.5 else ""))
        page = f"<!DOCTYPE html><html><head><title>{w.words(1, 6)}</title><style>p{{}}</style></head><body>{''.join(before)}<script>x('</p>')</script>{middle}{''.join(after)}"
        dom = parse(page + ("</body></html>" if r.random() < 0.9 else ""), mark_attribute="data-c")
        label = np.zeros(len(dom.parent))
        for i in range(1, len(label)):
            mark = dom.mark[i]
            label[i] = label[dom.parent[i]] if mark is None else mark == "1"
        yield dom, label
