"""Labelled pages to train the extraction on: page plans with a fixed seed, in which an attribute marks main text (1) and the rest (0)."""

from __future__ import annotations

import random

_SYLLABLES = ("an er in the tion re es on st ha ed and or ing ly ble ea nd".split(), "le ou ai en que re an ment eux é vi pa".split(), "ein sch er ge ung keit ver lich be te un".split(), "ción de os as mente co lla rr ez ga".split())
_PLAIN = {
    "nav": "Home News About Contact Sports Archive Blog Shop Help Login Topics".split(),
    "share": ["Share", "Tweet", "Print", "Email this", "Follow us", "Like"],
}
_CLASSES = {
    "main": ["content", "post", "entry-content", "article-body", "story", "post-body", "main-content", "page-content", "text", "blog-post", "articleBody", "prose"],
    "nav": ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "pagination", "top-nav", "site-navigation", "toc"],
    "ad": ["ad", "ads", "advert", "banner", "promo", "sponsored", "ad-slot", "advertisement", "adBox"],
    "side": ["sidebar", "side", "widget", "related", "popular-posts", "rail", "recommended", "also-read"],
    "foot": ["footer", "site-footer", "copyright", "legal", "foot"],
    "head": ["header", "masthead", "topbar", "site-header", "brand", "page-head"],
    "notice": ["notice", "cookie-banner", "consent", "alert", "newsletter", "subscribe-box", "paywall", "popup", "announcement", "gdpr"],
    "form": ["search", "login-form", "contact-form", "search-box", "poll"],
    "comment": ["comments", "comment-list", "disqus_thread", "responses", "reader-comments", "discussion", "comment", "feedback"],
    "share": ["share", "social", "tags", "meta", "byline", "toolbar"],
}


class _Page:
    def __init__(self, rng: random.Random):
        self.r = rng
        self.syllables = rng.choice(_SYLLABLES)

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.choice((1, 1, 2, 2, 3, 4))))

    def phrase(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self) -> str:
        text = self.phrase(self.r.randint(1, 18)).capitalize()
        if self.r.random() < 0.1:
            text = text.replace(" ", self.r.choice((" &amp; ", ", ", " <b>x</b> ", " &lt;", "&nbsp;", " &ndash; ", "; ", " (x) ")), 1)
        return text + self.r.choice(("." * 6) + "!?")

    def prose(self, low: int = 1, high: int = 7) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.12:
            text = text.replace(" ", ' <a href="/x">' + self.phrase(2) + "</a> ", 1)
        return text

    def name(self, kind: str) -> str:
        attr = self.r.choice(("class", "class", "id"))
        return f' {attr}="{self.r.choice(_CLASSES[kind])}"'

    def wrap(self, tag: str, attrs: str, inner: str, label: int | None = None) -> str:
        mark = f' data-label="{label}"' if label is not None else ""
        return f"<{tag}{attrs}{mark}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        names = [self.r.choice(_PLAIN["nav"]) if self.r.random() < 0.4 else self.phrase(self.r.randint(1, 6)) for _ in range(n)]
        if self.r.random() < 0.75:
            return "<ul>" + "".join(f'<li><a href="/{i}">{x}</a>' + ("</li>" if self.r.random() < 0.8 else "") for i, x in enumerate(names)) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(f'<a href="/{i}">{x}</a>' for i, x in enumerate(names))

    # ---- what is not main text -----------------------------------------------------------------------------------------------------

    def nav(self) -> str:
        tag = self.r.choice(("nav", "nav", "div", "ul", "header"))
        attrs = self.name("nav") if tag in ("div", "ul") and self.r.random() < 0.85 or self.r.random() < 0.3 else ""
        return self.wrap(tag, attrs, self.links(self.r.randint(2, 9)), 0)

    def head(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        inner = self.r.choice((f"<h1>{self.phrase(2)}</h1><p>{self.prose(1, 1)}</p>", f"<a href='/'>{self.phrase(1)}</a>", f"<div>{self.phrase(3)}</div>", f"<p>{self.prose(1, 2)}</p>"))
        return self.wrap(tag, self.name("head") if tag == "div" or self.r.random() < 0.3 else "", inner, 0)

    def foot(self) -> str:
        tag = self.r.choice(("footer", "footer", "div"))
        inner = self.r.choice((f"&copy; {self.r.randint(1999, 2024)} {self.phrase(2)}. All rights reserved.", f"&copy; {self.phrase(1)} &middot; Imprint &middot; {self.prose(1, 2)}", f"<p>{self.prose(1, 2)}</p>{self.links(3)}", self.prose(1, 2)))
        return self.wrap(tag, self.name("foot") if tag == "div" or self.r.random() < 0.2 else "", inner, 0)

    def ad(self) -> str:
        tag = self.r.choice(("div", "div", "aside", "section", "p"))
        return self.wrap(tag, self.name("ad"), self.r.choice((self.prose(1, 2), f"<a href='/buy'>{self.prose(1, 1)}</a>", f"<b>{self.phrase(3)}</b> {self.sentence()}" if tag == "p" else f"<p>{self.prose(1, 2)}</p>")), 0)

    def side(self) -> str:
        tag = self.r.choice(("aside", "aside", "div", "section"))
        inner = self.r.choice((f"<h3>{self.phrase(2)}</h3>{self.links(4)}", f"<p>{self.prose(1, 3)}</p>", f"<h2>{self.phrase(2)}</h2><p>{self.prose(1, 2)}</p>", self.prose(1, 2)))
        return self.wrap(tag, self.name("side") if tag != "aside" or self.r.random() < 0.5 else "", inner, 0)

    def notice(self) -> str:
        text = self.r.choice(("We use cookies. ", "Subscribe to our newsletter. ", "", "", "", "Read more with an account. ")) + self.prose(1, 2)
        tag = self.r.choice(("div", "div", "section", "p", "aside"))
        return self.wrap(tag, self.name("notice"), text if tag == "p" or self.r.random() < 0.5 else f"<p>{text}</p>", 0)

    def form(self) -> str:
        inner = f"<label>{self.phrase(2)}</label><input name=q>" + self.r.choice(("<button>Go</button>", f"<p>{self.prose(1, 1)}</p><button>Send</button>", f"<fieldset><legend>{self.phrase(3)}</legend><label>{self.phrase(4)}</label></fieldset>"))
        return self.wrap("form", self.name("form") if self.r.random() < 0.4 else "", inner, 0)

    def comments(self) -> str:
        one = lambda: self.r.choice((f"<p>{self.prose(1, 4)}</p>", f"<b>{self.word()}</b>: {self.prose(1, 3)}", f"<div><span>{self.phrase(2)}</span><p>{self.prose(1, 5)}</p></div>"))
        tag = self.r.choice(("section", "div", "div", "ol", "ul"))
        n = self.r.randint(1, 5)
        inner = "".join(f"<li>{one()}</li>" for _ in range(n)) if tag in ("ol", "ul") else (f"<h3>{self.phrase(2)}</h3>" if self.r.random() < 0.5 else "") + "".join(self.r.choice((f"<div class='comment'>{one()}</div>", one(), f"<article class='comment'>{one()}</article>")) for _ in range(n))
        return self.wrap(tag, self.name("comment"), inner, 0)

    def share(self) -> str:
        tag = self.r.choice(("div", "ul", "p"))
        inner = "".join(f"<li><a href='#'>{x}</a></li>" if tag == "ul" else f"<a href='#'>{x}</a> " for x in self.r.sample(_PLAIN["share"], 3))
        return self.wrap(tag, self.name("share"), inner, 0)

    # ---- what is ------------------------------------------------------------------------------------------------------------------

    def body(self) -> str:
        out = []
        if self.r.random() < 0.8:
            out.append(f"<h1>{self.phrase(self.r.randint(1, 9)).capitalize()}</h1>")
        for _ in range(self.r.randint(1, 12)):
            x = self.r.random()
            if x < 0.62:
                out.append(f"<p>{self.prose()}" + ("</p>" if self.r.random() < 0.9 else ""))
            elif x < 0.74:
                out.append(f"<p><b>{self.prose(1, 4)}<br>")  # left open
            elif x < 0.8:
                out.append(f"<h{self.r.randint(2, 4)}>{self.phrase(self.r.randint(1, 7))}</h{self.r.randint(2, 4)}>")
            elif x < 0.85:
                out.append("<ul>" + "".join(f"<li>{self.prose(1, 2)}</li>" for _ in range(self.r.randint(2, 4))) + "</ul>")
            elif x < 0.89:
                out.append(f"<blockquote>{self.prose(1, 3)}</blockquote>")
            elif x < 0.92:
                out.append("<table><tr>" + "".join(f"<td>{self.phrase(2)}</td>" for _ in range(3)) + "</tr></table>")
            elif x < 0.94:
                out.append(f"<pre>{self.phrase(6)}</pre>")
            elif x < 0.97:
                out.append(f"<div>{self.prose(1, 4)}</div>")
            elif x < 0.985:
                out.append(self.ad())
            else:
                out.append(self.r.choice((self.share, self.notice, self.side))())
        if self.r.random() < 0.1:
            out.append(self.comments())
        return "".join(out)

    def main(self) -> str:
        x = self.r.random()
        attrs = self.name("main") if self.r.random() < 0.4 else ""
        if x < 0.4:
            return self.wrap("article", attrs, self.body(), 1)
        if x < 0.5:
            return self.wrap("main", attrs, self.wrap("article", "", self.body()) if self.r.random() < 0.5 else self.body(), 1)
        if x < 0.85:
            return self.wrap(self.r.choice(("div", "div", "section")), self.name("main"), self.body(), 1)
        if x < 0.93:
            return self.wrap("div", "", self.body(), 1)
        return self.wrap("table", "", f"<tr><td>{self.body()}</td></tr>", 1)

    def page(self) -> str:
        before = self.r.sample((self.nav, self.head, self.ad, self.notice, self.form, self.nav, self.share, self.side), self.r.randint(0, 4))
        after = self.r.sample((self.foot, self.side, self.comments, self.ad, self.notice, self.form, self.nav, self.share, self.comments), self.r.randint(0, 5))
        parts = [f() for f in before] + [self.main()] + [f() for f in after]
        if self.r.random() < 0.7:
            parts.append(self.foot())
        return f"<html><head><title>{self.phrase(5)}</title></head><body data-label=0>" + "".join(parts) + "</body></html>"


def labelled_pages(count: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [_Page(rng).page() for _ in range(count)]
