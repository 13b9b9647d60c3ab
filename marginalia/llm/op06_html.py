"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into its leaf blocks in order: text between the boundaries of block elements, with the element's ancestors. Comments, head,
scripts, styles and controls of forms are no blocks. Each block has features of its ancestors (tags, and what their classes and ids hint
at) and of its text; a chain of two labels, main text or not, is scored by these and by the labels' transitions. The weights are trained by
gradient ascent on the likelihood of labelled pages (html_pages.py makes them from page plans with a fixed seed), and the best
chain is found by Viterbi.

Text in objects, canvases, media, formulas, drawings and noscript is text of the page like any other. A button or select that isn't closed ends
where a block element begins or an outer one ends. Labels are read from training pages only; a page's own attributes never are.

Defined results: a null or empty page, and one without main text, gives an empty text; unclosed, unmatched and unknown tags, and
entities that aren't closed, are read as browsers do as far as text goes; pages are taken whole; repeated rows give repeated rows; extra columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.session import ship

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)|[^<]++|<""",
    re.S,
)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?\Z", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold raw text up to their end tag, or the page's end; those that hold controls; and what isn't shown.
RAW = frozenset("script style iframe title textarea".split())
CONTROL = frozenset("select button datalist".split())
OPAQUE = RAW | CONTROL | {"template", "head"}
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in OPAQUE - CONTROL}
_OUTER = "article aside blockquote body div dl footer form h[1-6] header html li main nav ol p section table td th tr ul"
_CLOSE |= {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?|(?=<(?:{t}|{_OUTER.replace(' ', '|')})[\s/>])|(?=</(?:{_OUTER.replace(' ', '|')})[\s/>])", re.I) for t in CONTROL}
# the head ends where its end tag or the body is
_CLOSE["head"] = re.compile(r"</head(?=[\s/>])[^>]*>?|(?=<body[\s>])", re.I)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of the values, unless one of the barriers is nearer.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = frozenset("ul ol menu dl table body html div section article".split())
#: What names of classes and ids hint at.
HINTS = {
    "comment": "comment comments commentlist disqus reply replies respond discussion discuss feedback reader readers opinions responses guestbook thread",
    "ad": "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner promo promotion promoted sponsor sponsored sponsors commercial dfp",
    "nav": "nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs crumbs pagination pager paging tabs tabbar toc skip links linklist sitemap categories",
    "side": "sidebar side aside widget widgets related recommended recommendations more popular trending teaser teasers rail latest also",
    "foot": "footer foot copyright legal colophon imprint bottom disclaimer",
    "head": "header head masthead topbar top brand logo tagline sitename hero",
    "notice": "notice notices cookie cookies consent gdpr privacy alert alerts popup modal overlay newsletter subscribe subscription paywall announcement warning message toast banner-notice info signup",
    "form": "form search searchbox login signin register contact field input poll survey",
    "share": "share sharing social tags tag meta byline author authors date dateline toolbar tools print rating likes follow buttons",
    "main": "content article post entry story body text main page prose copy maincontent articlebody postbody blogpost paragraph",
}
_HINT = {w: g for g, ws in HINTS.items() for w in ws.split()}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Words in a block's text that speak of what it is, in several languages.
_BOILER = re.compile(r"©|\(c\)|copyright|all rights|cookie|newsletter|subscribe|sign up|log ?in|privacy|share|advertis|sponsor|comment|reply|read more|impressum|datenschutz|werbung|anzeige|publicité|publicidad|mentions légales", re.I)


#: Elements that say what they hold, whatever they are named.
_TELLING = frozenset(("nav", "aside", "footer", "header", "form", "article", "main"))


@dataclass(eq=False)
class Path:
    """A block element and what it and its ancestors say; equal ones of a page are one object, so depth costs a block nothing."""

    tag: str
    own: frozenset[str]
    tags: frozenset[str]
    hints: frozenset[str]
    #: the nearest element that says anything
    near: str


@dataclass
class Block:
    text: str
    path: Path
    linked: int
    label: int | None = None


@dataclass
class _Element:
    tag: str
    #: of the nearest block element, itself included
    path: Path
    #: of the nearest element with one, itself included
    label: int | None


_named: dict[str, frozenset[str]] = {}


def _hints(names: str) -> frozenset[str]:
    if names not in _named:
        if len(_named) > 50_000:
            _named.clear()
        words = {w.lower() for w in _NAME.findall(names)}
        _named[names] = frozenset(_HINT[w] for w in words if w in _HINT)
    return _named[names]


def _attributes(text: str, labelled: bool) -> tuple[str, int | None, bool]:
    """(names of class and id, label of a training page, is it hidden)"""
    names, label, hidden = "", None, False
    if "=" in text or "hidden" in text:
        for name, value in _ATTRIBUTE.findall(text):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                names += " " + value
            elif labelled and name == "data-label":
                label = int(value)
            elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower() or name == "aria-hidden" and value == "true":
                hidden = True
    return names, label, hidden


def blocks(page: str, labelled: bool = False) -> list[Block]:
    """The leaf blocks of a page in order; with their labels if it's one of the training pages."""
    none: frozenset[str] = frozenset()
    stack = [_Element("html", Path("html", none, frozenset(("html",)), none, "none"), None)]
    paths: dict[tuple[int, str, frozenset[str]], Path] = {}
    # places in the stack of the open elements by tag, and of the block elements; the root isn't among them
    places: dict[str, list[int]] = {}
    open_blocks: list[int] = []
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, stack[-1].path, linked, stack[-1].label))
            parts.clear()
        linked = 0

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else 0

    def push(tag: str, hints: frozenset[str], label: int | None, hidden: bool) -> None:
        above = stack[-1]
        path = above.path
        if tag in BLOCK:
            own = hints | {"hidden"} if hidden else hints
            key = (id(path), tag, own)
            if key not in paths:
                near = tag if tag in _TELLING else min(own) if own else path.near
                paths[key] = Path(tag, own, path.tags | {tag}, path.hints | own, near)
            path = paths[key]
            open_blocks.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append(_Element(tag, path, above.label if label is None else label))

    def pop(i: int) -> None:
        if open_blocks and open_blocks[-1] >= i:
            flush()
        for e in stack[i:]:
            places[e.tag].pop()
            if e.tag in BLOCK:
                open_blocks.pop()
        del stack[i:]

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        token = m.group()
        at = m.end()
        if token[0] != "<" or len(token) == 1:
            text = html.unescape(token) if "&" in token else token
            parts.append(text)
            if any(e.tag == "a" for e in stack[-4:]):
                linked += len(text.strip())
            continue
        slash, tag, rest = m.group(1), m.group(2), m.group(3)
        if tag is None:
            loose = _LOOSE.match(token)
            if not loose:
                if token.startswith("<![CDATA["):
                    parts.append(token[9:].removesuffix("]]>"))
                continue
            slash, tag, rest = loose.groups()
        tag = tag.lower()
        if slash:
            if tag == "br":
                parts.append(" ")
            i = last(tag)
            if i and (tag in BLOCK or not open_blocks or i > open_blocks[-1]):
                pop(i)
            elif tag in BLOCK:
                flush()
            continue
        if tag in OPAQUE:
            end = _CLOSE[tag].search(page, at)
            at = end.end() if end else size if tag in RAW else at
            continue
        if tag in ("br", "wbr", "img"):
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            if tag not in ("html", "body") and open_blocks and stack[open_blocks[-1]].tag == "p":
                pop(open_blocks[-1])
            while tag in _CLOSES:
                i = max(map(last, _CLOSES[tag]))
                if i <= max(map(last, _BARRIER)):
                    break
                pop(i)
                if tag != "tr":
                    break
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        names, label, hidden = _attributes(rest, labelled)
        push(tag, _hints(names) if names else none, label, hidden)
    flush()
    return out


def _grade(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features that each block has."""
    out = []
    n = len(found)
    for i, b in enumerate(found):
        f = ["bias"]
        f += ["in:" + t for t in sorted(b.path.tags.difference(("html", "body", "div")))]
        f += ["hint:" + h for h in sorted(b.path.hints)]
        f.append("tag:" + b.path.tag)
        f += ["own:" + h for h in sorted(b.path.own)]
        f.append("near:" + b.path.near)
        chars = len(b.text)
        words = b.text.count(" ") + 1
        f.append(f"words:{_grade(words, (2, 4, 8, 15, 30, 60))}")
        f.append(f"linked:{_grade(b.linked / chars, (0.01, 0.3, 0.7))}")
        f.append(f"stops:{_grade(sum(b.text.count(c) for c in '.!?') / words, (0.01, 0.1, 0.3))}")
        f.append(f"upper:{b.text[0].isupper()}")
        f.append(f"ends:{b.text[-1] in '.!?:;…"'}")
        if _BOILER.search(b.text):
            f.append(f"speaks:{words < 40}")
        f.append(f"place:{_grade(i / n, (0.1, 0.5, 0.9))}")
        if i and found[i - 1].path is b.path:
            f.append("like-before")
        out.append(f)
    return out


class Crf:
    """Two labels; weights of features for label 1, of the transitions between labels, and of the first label."""

    def __init__(self, names: list[str]):
        self.index = {f: i for i, f in enumerate(names)}
        self.weights = np.zeros(len(names))
        self.moves = np.zeros((2, 2))
        self.first = np.zeros(2)

    def emissions(self, rows: list[list[str]]) -> list[float]:
        get, w = self.index.get, self.plain
        return [sum([w[k] for f in fs if (k := get(f)) is not None]) for fs in rows]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, rate: float = 0.15, penalty: float = 0.3) -> None:
        """Gradient ascent on the likelihood of all pages at once, with Adam's step sizes."""
        count, width = len(pages), max(len(y) for _, y in pages)
        length = np.array([len(y) for _, y in pages])
        inside = np.arange(width) < length[:, None]
        gold = np.zeros((count, width), np.int64)
        cell, which = [], []
        for p, (rows, y) in enumerate(pages):
            gold[p, : len(y)] = y
            for t, fs in enumerate(rows):
                for f in fs:
                    cell.append(p * width + t)
                    which.append(self.index[f])
        cell, which = np.array(cell), np.array(which)
        size = len(self.index)
        theta = np.zeros(size + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        last = length - 1
        rows = np.arange(count)
        pair = inside[:, 1:]
        for step in range(1, steps + 1):
            e = np.zeros((count, width, 2))
            e[:, :, 1] = np.bincount(cell, theta[which], count * width).reshape(count, width)
            moves, first = theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
            fwd, bwd = np.zeros((count, width, 2)), np.zeros((count, width, 2))
            fwd[:, 0] = first + e[:, 0]
            for t in range(1, width):
                fwd[:, t] = np.where(inside[:, t, None], np.logaddexp.reduce(fwd[:, t - 1, :, None] + moves, 1) + e[:, t], fwd[:, t - 1])
            total = np.logaddexp.reduce(fwd[rows, last], 1)
            for t in range(width - 2, -1, -1):
                bwd[:, t] = np.where(inside[:, t + 1, None], np.logaddexp.reduce(moves + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
            node = np.exp(np.minimum(fwd + bwd - total[:, None, None], 0)) * inside[:, :, None]
            edge = np.exp(np.minimum(fwd[:, :-1, :, None] + moves + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None], 0)) * pair[:, :, None, None]
            grad = np.zeros_like(theta)
            grad[:size] = np.bincount(which, (gold - node[:, :, 1]).ravel()[cell], size)
            real = np.zeros((2, 2))
            np.add.at(real, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
            grad[size : size + 4] = (real - edge.sum((0, 1))).ravel()
            grad[size + 4 :] = np.bincount(gold[:, 0], minlength=2) - node[:, 0].sum(0)
            grad = (grad - penalty * theta) / count
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves, self.first = theta[:size].copy(), theta[size : size + 4].reshape(2, 2).copy(), theta[size + 4 :].copy()

    @property
    def plain(self) -> list[float]:
        if not hasattr(self, "_plain"):
            self._plain = self.weights.tolist()
        return self._plain

    def viterbi(self, emissions: list[float]) -> list[int]:
        (a, b), (c, d) = self.moves.tolist()
        s0, s1 = self.first.tolist()
        s1 += emissions[0]
        back = []
        for e in emissions[1:]:
            from0, from1 = s0 + a >= s1 + c, s0 + b >= s1 + d
            back.append((0 if from0 else 1, 0 if from1 else 1))
            s0, s1 = (s0 + a if from0 else s1 + c), (s0 + b if from1 else s1 + d) + e
        label = int(s1 > s0)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


_trained: dict[tuple[int, int], Crf] = {}


def train(count: int = 400, seed: int = 11) -> Crf:
    """The model of the labelled pages; they are of a fixed number."""
    if (count, seed) not in _trained:
        from marginalia.llm.html_pages import labelled_pages

        pages = []
        for page in labelled_pages(count, seed):
            found = blocks(page, labelled=True)
            if found:
                pages.append((features(found), [b.label or 0 for b in found]))
        crf = Crf(sorted({f for rows, _ in pages for fs in rows for f in fs}))
        crf.fit(pages)
        _trained[count, seed] = crf
    return _trained[count, seed]


def main_text(page: str | None, crf: Crf) -> str:
    if not page:
        return ""
    found = blocks(page)
    if not found:
        return ""
    labels = crf.viterbi(crf.emissions(features(found)))
    return "\n\n".join(b.text for b, y in zip(found, labels, strict=True) if y)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars. A map without a shuffle."""
    ship(pages.sparkSession)
    crf = train()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, crf) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(rows, "page_id long, url string, text string, n_chars long")
