"""Lexers: every comment of a source with its byte span and lexical kind, and what is wrong with the source.

A source is read as ISO-8859-1, so indexes are byte offsets. Each language states one pattern of the places where something can begin
(comments, literals, braces, tags); the scanner jumps from one to the next by that pattern and a method for each takes it from there.
Code inside literals (templates, holes, substitutions) is scanned by the same method, up to NESTING deep.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

NESTING = 256


class Stop(Exception):
    """Nothing after this can be told."""


def mapped(text: str, pattern: str, value: Callable[[re.Match], str]) -> tuple[str, list[int] | None]:
    """The text with each match replaced, and for each of its characters (and its end) the offset in the text; None if nothing matched."""
    if not re.search(pattern, text):
        return text, None
    out, at, last = [], [], 0
    for m in re.finditer(pattern, text):
        out.append(text[last : m.start()])
        at += range(last, m.start())
        new = value(m)
        out.append(new)
        at += [m.start()] * len(new)
        last = m.end()
    out.append(text[last:])
    at += range(last, len(text) + 1)
    return "".join(out), at


class Lexer:
    """One language. Subclasses give `begin`, a pattern with named groups, and a method for each name."""

    begin = r"(?!)"
    flags = re.S

    def __init__(self, text: str, dialect: str = "standard"):
        self.s, self.n, self.dialect = text, len(text), dialect
        self.comments: list[tuple[int, int, str]] = []
        self.errors: list[tuple[str, int, int]] = []
        self.depth = 0
        self.next = self.pattern(dialect)

    @classmethod
    @lru_cache(64)
    def pattern(cls, dialect: str):
        return re.compile(cls.begin_of(dialect), cls.flags)

    @classmethod
    def begin_of(cls, dialect: str) -> str:
        return cls.begin

    def run(self) -> None:
        try:
            self.code(0)
        except Stop:
            pass

    def code(self, i: int, stop: str = "") -> int:
        """Scan code from i to the closing bracket `stop` that isn't opened here, or to the end; gives the place after it."""
        self.depth += 1
        if self.depth > NESTING:
            self.errors.append(("nesting-limit", i, self.n))
            raise Stop
        opened = 0
        pair = {"}": "{", ")": "(", "]": "["}.get(stop)
        while m := self.next.search(self.s, i):
            kind = m.lastgroup
            if kind == "bracket":
                i = m.end()
                if m.group() == pair:
                    opened += 1
                elif m.group() == stop:
                    if not opened:
                        self.depth -= 1
                        return i
                    opened -= 1
                continue
            i = max(getattr(self, kind)(m), m.start() + 1)
        self.depth -= 1
        return self.n

    # ---- pieces that languages share --------------------------------------------------------------------------------------------

    def comment(self, a: int, b: int, kind: str) -> int:
        self.comments.append((a, b, kind))
        return b

    def error(self, code: str, a: int, b: int) -> int:
        self.errors.append((code, a, b))
        return b

    line_end = re.compile(r"[\r\n]|\Z")

    def to_line_end(self, i: int) -> int:
        return self.line_end.search(self.s, i).start()

    def line_kind(self, a: int) -> str:
        s = self.s
        return "doc-line" if s.startswith("//!", a) or s.startswith("///", a) and not s.startswith("////", a) else "line"

    def block_kind(self, a: int) -> str:
        s = self.s
        return "doc-block" if s.startswith("/*!", a) or s.startswith("/**", a) and not s.startswith(("/***", "/**/"), a) else "block"

    def line(self, m) -> int:
        return self.comment(m.start(), self.to_line_end(m.start()), self.line_kind(m.start()))

    nested = False
    ends = ("/*", "*/")

    def block(self, m) -> int:
        a = m.start()
        opener, closer = self.ends
        i = a + len(opener)
        if self.nested:
            depth, both = 1, re.compile(re.escape(opener) + "|" + re.escape(closer))
            while depth:
                x = both.search(self.s, i)
                if not x:
                    i = -1
                    break
                depth += 1 if x.group() == opener else -1
                i = x.end()
        else:
            i = self.s.find(closer, i)
            i = i + len(closer) if i >= 0 else -1
        if i < 0:
            self.comment(a, self.n, self.block_kind(a))
            return self.error("unterminated-comment", a, self.n)
        return self.comment(a, i, self.block_kind(a))

    def quoted(self, a: int, i: int, quote: str, lines: bool = False, escape: str = "\\", doubled: bool = False) -> int:
        """A literal whose text begins at i; a backslash takes the next byte along."""
        p = _quoted_pattern(quote, lines, escape)
        while True:
            m = p.search(self.s, i)
            if not m:
                return self.error("unterminated-string", a, self.n)
            x = m.group()
            if x == quote:
                if doubled and self.s.startswith(quote, m.end()):
                    i = m.end() + len(quote)
                    continue
                return m.end()
            if x in "\r\n":
                self.error("unterminated-string", a, m.start())
                return m.start()
            i = min(m.end() + 1, self.n)

    def until(self, a: int, i: int, closer: str, code: str = "unterminated-string") -> int:
        end = self.s.find(closer, i)
        return end + len(closer) if end >= 0 else self.error(code, a, self.n)

    def single(self, m) -> int:
        return self.quoted(m.start(), m.end(), m.group()[-1])

    def multi(self, m) -> int:
        return self.quoted(m.start(), m.end(), m.group()[-1], lines=True)

    def triple(self, m) -> int:
        return self.quoted(m.start(), m.end(), m.group()[-3:], lines=True)

    def skip(self, m) -> int:
        return m.end()

    def child(self, language: str, dialect: str, a: int, b: int) -> None:
        """Scan a part as another language; its spans are shifted."""
        comments, errors = scan_text(self.s[a:b], language, dialect, embedded=True)
        self.comments += [(x + a, y + a, k) for x, y, k in comments]
        self.errors += [(c, x + a, y + a) for c, x, y in errors]


@lru_cache(256)
def _quoted_pattern(quote: str, lines: bool, escape: str):
    return re.compile("|".join([re.escape(quote)] + ([re.escape(escape)] if escape else []) + ([] if lines else [r"[\r\n]"])))


class C(Lexer):
    begin = r"(?P<line>//)|(?P<block>/\*)|(?P<single>\"|(?<![0-9a-fA-F])')"


class Cpp(C):
    begin = r"(?P<line>//)|(?P<block>/\*)|(?P<raw>(?<![A-Za-z0-9_])(?:u8|u|U|L)?R\"(?P<tag>[^()\\\s]{0,16})\()|(?P<single>\"|(?<![0-9a-fA-F])')"

    def raw(self, m) -> int:
        return self.until(m.start(), m.end(), ")" + m.group("tag") + '"')


class Rust(Lexer):
    begin = r"(?P<line>//)|(?P<block>/\*)|(?P<raw>(?<![A-Za-z0-9_])(?:b|c)?r(?P<hashes>#*)\")|(?P<multi>\")|(?P<char>'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^\\'\r\n]{1,4})')|(?P<skip>'[A-Za-z_])"
    nested = True

    def raw(self, m) -> int:
        return self.until(m.start(), m.end(), '"' + m.group("hashes"))

    char = Lexer.skip


class Go(Lexer):
    begin = r"(?P<line>//)|(?P<block>/\*)|(?P<rawtick>`)|(?P<single>[\"'])"

    def rawtick(self, m) -> int:
        return self.until(m.start(), m.end(), "`")


class Java(Lexer):
    begin = r"(?P<line>//)|(?P<block>/\*)|(?P<triple>\"\"\")|(?P<single>[\"'])"

    def line_kind(self, a: int) -> str:
        return "doc-line" if self.s.startswith("///", a) else "line"

    def block_kind(self, a: int) -> str:
        return "doc-block" if self.s.startswith("/**", a) and not self.s.startswith("/**/", a) else "block"


class Jsonc(Lexer):
    begin = r"(?P<line>//)|(?P<block>/\*)|(?P<single>[\"'])"


class Css(Lexer):
    begin = r"(?P<block>/\*)|(?P<single>[\"'])"

    @classmethod
    def begin_of(cls, dialect: str) -> str:
        if dialect in ("scss", "sass"):
            return r"(?P<block>/\*)|(?P<url>\burl\(\s*(?![\"'\s])[^)\r\n]*\))|(?P<line>//)|(?P<single>[\"'])|(?P<hole>#\{)|(?P<bracket>[{}])"
        return cls.begin

    url = Lexer.skip

    def hole(self, m) -> int:
        return self.code(m.end(), "}")

    def line(self, m) -> int:
        a = m.start()
        end = self.to_line_end(a)
        if self.dialect == "sass":  # owns the lines that are indented deeper
            indent = a - (self.s.rfind("\n", 0, a) + 1)
            while True:
                x = re.compile(r"\r?\n(?:[ \t]*\r?\n)*([ \t]+)[^\s]").match(self.s, end)
                if not x or len(x.group(1)) <= indent:
                    break
                end = self.to_line_end(x.end())
        return self.comment(a, end, self.line_kind(a))


class Kotlin(Lexer):
    begin = r"(?P<line>//)|(?P<block>/\*)|(?P<text>\$*(?:\"\"\"|\"))|(?P<char>'(?:\\u[0-9a-fA-F]{4}|\\.|[^\\'\r\n]{1,4})')|(?P<bracket>[{}])"
    nested = True
    char = Lexer.skip

    def text(self, m) -> int:
        width = max(1, m.group().count("$"))
        long = m.group().endswith('"""')
        hole = re.compile((r"\"\"\"+" if long else r"\"|\\.|[\r\n]") + r"|\$+\{", re.S)
        i = m.end()
        while x := hole.search(self.s, i):
            i = x.end()
            t = x.group()
            if t[0] == "$":
                if len(t) - 1 >= width:
                    i = self.code(i, "}")
            elif t[0] == '"':
                return i
            elif t in "\r\n":
                return self.error("unterminated-string", m.start(), x.start())
        return self.error("unterminated-string", m.start(), self.n)


class Dart(Lexer):
    begin = r"(?P<line>//|#!(?<=\A#!))|(?P<block>/\*)|(?P<raw>(?<![A-Za-z0-9_$])r(?:\"\"\"|'''|[\"']))|(?P<text>\"\"\"|'''|[\"'])|(?P<bracket>[{}])"
    nested = True

    def line_kind(self, a: int) -> str:
        return "doc-line" if self.s.startswith("///", a) else "line"

    def block_kind(self, a: int) -> str:
        return "doc-block" if self.s.startswith("/**", a) else "block"

    def raw(self, m) -> int:
        q = m.group()[1:]
        return self.quoted(m.start(), m.end(), q, lines=len(q) == 3, escape="")

    def text(self, m) -> int:
        q = m.group()
        part = re.compile(re.escape(q) + r"|\\.|\$\{" + ("" if len(q) == 3 else r"|[\r\n]"), re.S)
        i = m.end()
        while x := part.search(self.s, i):
            i = x.end()
            if x.group() == "${":
                i = self.code(i, "}")
            elif x.group() == q:
                return i
            elif x.group() in "\r\n":
                return self.error("unterminated-string", m.start(), x.start())
        return self.error("unterminated-string", m.start(), self.n)


class Swift(Lexer):
    begin = r"(?P<line>//)|(?P<block>/\*)|(?P<text>(?P<hashes>#*)(?:\"\"\"|\"))|(?P<regex>(?P<marks>#+)/)|(?P<bracket>[()])"
    nested = True

    def line_kind(self, a: int) -> str:
        return "doc-line" if self.s.startswith("///", a) else "line"

    def block_kind(self, a: int) -> str:
        return "doc-block" if self.s.startswith("/**", a) and not self.s.startswith("/**/", a) else "block"

    def text(self, m) -> int:
        h = m.group("hashes")
        long = m.group().endswith('"""')
        close = ('"""' if long else '"') + h
        part = re.compile(re.escape(close) + r"|\\" + h + r"(?:\(|.)" + ("" if long else r"|[\r\n]"), re.S)
        i = m.end()
        while x := part.search(self.s, i):
            i = x.end()
            if x.group().startswith("\\"):
                if x.group().endswith("("):
                    i = self.code(i, ")")
            elif x.group() == close:
                return i
            else:
                return self.error("unterminated-string", m.start(), x.start())
        return self.error("unterminated-string", m.start(), self.n)

    def regex(self, m) -> int:
        return self.until(m.start(), m.end(), "/" + m.group("marks"), "unterminated-regex")


class CSharp(Lexer):
    begin = r"(?P<line>//)|(?P<block>/\*)|(?P<directive>(?m:^[ \t]*#[^\r\n]*))|(?P<raw>\$*\"\"\"+)|(?P<verbatim>(?:\$@|@\$|@)\")|(?P<hole>\$\")|(?P<single>\"|')|(?P<bracket>[{}])"

    def line_kind(self, a: int) -> str:
        return "doc-line" if self.s.startswith("///", a) and not self.s.startswith("////", a) else "line"

    def block_kind(self, a: int) -> str:
        return "doc-block" if self.s.startswith("/**", a) and not self.s.startswith(("/***", "/**/"), a) else "block"

    line_end = re.compile("[\r\n]|\xc2\x85|\xe2\x80[\xa8\xa9]|\\Z")

    def directive(self, m) -> int:
        if re.match(r"[ \t]*#\s*(?:region|endregion|error|warning|pragma|!)", m.group()):
            return m.end()
        x = m.group().find("//")
        return m.start() + x if x >= 0 else m.end()

    def raw(self, m) -> int:
        dollars, quotes = m.group().count("$"), m.group().count('"')
        part = re.compile('"{%d,}' % quotes + (r"|\{{%d,}" % dollars if dollars else ""))
        i = m.end()
        while x := part.search(self.s, i):
            i = x.end()
            if x.group()[0] == '"':
                return i
            i = self.code(i, "}")
        return self.error("unterminated-string", m.start(), self.n)

    def verbatim(self, m) -> int:
        part = re.compile(r'""|"' + (r"|\{\{|\{" if "$" in m.group() else ""))
        return self._holes(m, part)

    def hole(self, m) -> int:
        return self._holes(m, re.compile(r'\\.|"|\{\{|\{|[\r\n]', re.S))

    def _holes(self, m, part) -> int:
        i = m.end()
        while x := part.search(self.s, i):
            i = x.end()
            t = x.group()
            if t == '"':
                return i
            if t == "{":
                i = self.code(i, "}")
            elif t in "\r\n":
                return self.error("unterminated-string", m.start(), x.start())
        return self.error("unterminated-string", m.start(), self.n)


class Scala(Lexer):
    begin = r"(?P<line>//)|(?P<block>/\*)|(?P<text>(?P<by>(?<![A-Za-z0-9_$])[A-Za-z_$][A-Za-z0-9_$]*)?(?:\"\"\"|\"))|(?P<char>'(?:\\u+[0-9a-fA-F]{4}|\\.|[^\\'\r\n]{1,4})')|(?P<name>`[^`\r\n]*`)|(?P<element>(?<![^\s({])<(?=[A-Za-z_!?]))|(?P<bracket>[{}])"
    nested = True
    char = name = Lexer.skip
    _markup = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|</[^>]*>|<[A-Za-z_]|\{\{|\{", re.S)
    _tag = re.compile(r"/>|>|\"[^\"]*\"|'[^']*'|\{")

    def element(self, m) -> int:
        """An XML literal: its text is no code, and {} in it and in its tags is."""
        i, depth = m.start(), 0
        while x := self._markup.search(self.s, i):
            i, t = x.end(), x.group()
            if t == "{":
                i = self.code(i, "}")
            elif t[:2] == "</":
                depth -= 1
            elif t[0] == "<" and t[1] not in "!?":
                while y := self._tag.search(self.s, i):
                    i = y.end() if y.group() != "{" else self.code(y.end(), "}")
                    if y.group() in (">", "/>"):
                        break
                else:
                    break
                depth += y.group() == ">"
            if depth <= 0 and t[0] == "<":
                return i
        return self.error("lexical-ambiguity", m.start(), self.n)

    def line_kind(self, a: int) -> str:
        return "line"

    def block_kind(self, a: int) -> str:
        return "doc-block" if self.s.startswith("/**", a) and not self.s.startswith("/**/", a) else "block"

    def text(self, m) -> int:
        long, holes = m.group().endswith('"""'), bool(m.group("by"))
        part = re.compile((r'"""+' if long else r'"|[\r\n]') + ("" if long else r"|\\.") + (r"|\$\$|\$\{" if holes else ""), re.S)
        i = m.end()
        while x := part.search(self.s, i):
            i = x.end()
            t = x.group()
            if t == "${":
                i = self.code(i, "}")
            elif t[0] == '"':
                return i
            elif t in "\r\n":
                return self.error("unterminated-string", m.start(), x.start())
        return self.error("unterminated-string", m.start(), self.n)


class Zig(Lexer):
    begin = r"(?P<line>//)|(?P<text>\\\\[^\n]*)|(?P<single>[\"'])"
    text = Lexer.skip

    def line_kind(self, a: int) -> str:
        return "doc-line" if self.s.startswith("//!", a) or self.s.startswith("///", a) and not self.s.startswith("////", a) else "line"


class Ocaml(Lexer):
    begin = r"(?P<block>\(\*)|(?P<quoted_id>\{(?P<id>[a-z_]*)\|)|(?P<multi>\")|(?P<char>'(?:\\(?:[0-9]{3}|x[0-9a-fA-F]{2}|o[0-7]{3}|u\{[^}]*\}|.)|[^\\'\r\n])')"
    char = Lexer.skip

    def block_kind(self, a: int) -> str:
        return "doc-block" if self.s.startswith("(**", a) and not self.s.startswith(("(***", "(**)"), a) else "block"

    def quoted_id(self, m) -> int:
        return self.until(m.start(), m.end(), "|" + m.group("id") + "}")

    def block(self, m) -> int:
        a, i, depth = m.start(), m.end(), 1
        inner = re.compile(r"\(\*|\*\)|\"(?:\\.|[^\"\\])*\"|\{(?P<id>[a-z_]*)\|.*?\|(?P=id)\}|'(?:\\.|[^\\'\r\n])'", re.S)
        while depth:
            x = inner.search(self.s, i)
            if not x:
                self.comment(a, self.n, self.block_kind(a))
                return self.error("unterminated-comment", a, self.n)
            i = x.end()
            depth += {"(*": 1, "*)": -1}.get(x.group(), 0)
        return self.comment(a, i, self.block_kind(a))


class Hash(Lexer):
    def line_kind(self, a: int) -> str:
        return "line"


class Python(Hash):
    begin = r"(?P<line>\#)|(?P<fstring>(?<![A-Za-z0-9_])(?:[rR][fFtT]|[fFtT][rR]?)(?:\"\"\"|'''|[\"']))|(?P<text>(?:(?<![A-Za-z0-9_])(?:[bB][rR]?|[rR][bB]?|[uU]))?(?:\"\"\"|'''|[\"']))|(?P<bracket>[{}])"

    def text(self, m) -> int:
        q = m.group().lstrip("bBrRuU")
        return self.quoted(m.start(), m.end(), q, lines=len(q) == 3)

    def fstring(self, m) -> int:
        q = m.group().lstrip("fFrRtT")
        part = re.compile(re.escape(q) + r"|\\.|\{\{|\{" + ("" if len(q) == 3 else r"|[\r\n]"), re.S)
        i = m.end()
        while x := part.search(self.s, i):
            i = x.end()
            t = x.group()
            if t == q:
                return i
            if t == "{":
                i = self.code(i, "}")
            elif t in "\r\n":
                return self.error("unterminated-string", m.start(), x.start())
        return self.error("unterminated-string", m.start(), self.n)


class Toml(Hash):
    begin = r"(?P<line>\#)|(?P<triple>\"\"\")|(?P<literal>'''|')|(?P<single>\")"

    def triple(self, m) -> int:
        end = super().triple(m)
        extra = re.compile('"{0,2}').match(self.s, end)
        return extra.end() if end < self.n else end

    def literal(self, m) -> int:
        q = m.group()
        end = self.quoted(m.start(), m.end(), q, lines=len(q) == 3, escape="")
        return re.compile("'{0,2}").match(self.s, end).end() if len(q) == 3 and end < self.n else end


class Lua(Lexer):
    begin = r"(?P<line>--|\#(?<=\A\#))|(?P<long>\[(?P<level>=*)\[)|(?P<single>[\"'])"

    def line_kind(self, a: int) -> str:
        return "doc-line" if self.s.startswith("---", a) and not self.s.startswith("----", a) else "line"

    def line(self, m) -> int:
        x = re.compile(r"--\[(=*)\[").match(self.s, m.start())
        if not x:
            return super().line(m)
        close = "]" + x.group(1) + "]"
        end = self.s.find(close, x.end())
        if end < 0:
            self.comment(m.start(), self.n, "block")
            return self.error("unterminated-comment", m.start(), self.n)
        return self.comment(m.start(), end + len(close), "block")

    def long(self, m) -> int:
        return self.until(m.start(), m.end(), "]" + m.group("level") + "]")

    def single(self, m) -> int:
        q = m.group()
        part = re.compile(re.escape(q) + r"|\\z\s*|\\\r\n|\\.|[\r\n]", re.S)
        i = m.end()
        while x := part.search(self.s, i):
            i = x.end()
            if x.group() == q:
                return i
            if x.group() in "\r\n":
                return self.error("unterminated-string", m.start(), x.start())
        return self.error("unterminated-string", m.start(), self.n)


class R(Hash):
    begin = r"(?P<line>\#)|(?P<raw>(?<![A-Za-z0-9_.])[rR][\"'](?P<dashes>-*)(?P<open>[(\[{]))|(?P<multi>[\"'`])|(?P<operator>%[^%\r\n]*%)"
    operator = Lexer.skip

    def line_kind(self, a: int) -> str:
        return "doc-line" if self.s.startswith("#'", a) else "line"

    def raw(self, m) -> int:
        close = {"(": ")", "[": "]", "{": "}"}[m.group("open")] + m.group("dashes") + m.group()[1]
        return self.until(m.start(), m.end(), close)


class Sql(Lexer):
    begin = r"(?P<line>--)|(?P<block>/\*)|(?P<text>(?:(?<![A-Za-z0-9_])[eEnN])?')|(?P<name>[\"`])"

    @classmethod
    def begin_of(cls, dialect: str) -> str:
        extra = {"mysql": r"(?P<hash>\#)|", "postgresql": r"(?P<dollar>\$(?P<tag>[A-Za-z_0-9]*)\$)|", "t-sql": r"(?P<square>\[)|", "oracle": r"(?P<q>(?<![A-Za-z0-9_])[nN]?[qQ]'(?P<open>[^\s]))|"}.get(dialect, "")
        return extra + cls.begin

    @property
    def nested(self) -> bool:
        return self.dialect in ("postgresql", "t-sql")

    def line_kind(self, a: int) -> str:
        return "line"

    def block_kind(self, a: int) -> str:
        return "block"

    def line(self, m) -> int:
        if self.dialect == "mysql" and self.s[m.end() : m.end() + 1] not in ("", " ", "\t", "\r", "\n", "\x0b", "\x0c"):
            return m.end()
        return super().line(m)

    def hash(self, m) -> int:
        return self.comment(m.start(), self.to_line_end(m.start()), "line")

    def text(self, m) -> int:
        escaped = self.dialect == "mysql" or self.dialect == "postgresql" and m.group()[0] in "eE"
        return self.quoted(m.start(), m.end(), "'", lines=True, escape="\\" if escaped else "", doubled=True)

    def name(self, m) -> int:
        return self.quoted(m.start(), m.end(), m.group(), lines=True, escape="\\" if self.dialect == "mysql" else "", doubled=True)

    def dollar(self, m) -> int:
        return self.until(m.start(), m.end(), m.group())

    def square(self, m) -> int:
        return self.quoted(m.start(), m.end(), "]", lines=True, escape="", doubled=True)

    def q(self, m) -> int:
        o = m.group("open")
        return self.until(m.start(), m.end(), {"(": ")", "[": "]", "{": "}", "<": ">"}.get(o, o) + "'")


class JavaScript(Lexer):
    begin = r"(?P<hashbang>\A\#![^\r\n]*)|(?P<line>//|<!--|(?m:^)[ \t]*-->)|(?P<block>/\*)|(?P<regex>/)|(?P<template>`)|(?P<single>[\"'])|(?P<bracket>[{}])"
    line_end = re.compile("[\r\n]|\xe2\x80[\xa8\xa9]|\\Z")
    _words = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
    _tail = re.compile(r"([A-Za-z_$\x80-\xff][\w$\x80-\xff]*|[0-9][\w.]*|\+\+|--|[^\s])\s*\Z")
    _regex = re.compile(r"/(?![*/])(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\[\r\n])+/[A-Za-z]*")

    def hashbang(self, m) -> int:
        return self.comment(m.start(), m.end(), "line")

    def line(self, m) -> int:
        a = m.end() - 3 if m.group().endswith("-->") else m.start()
        return self.comment(a, self.to_line_end(a), self.line_kind(a) if self.s[a] == "/" else "line")

    def before(self, i: int) -> str:
        """The last token before i that is no white space and no comment."""
        for a, b, _ in reversed(self.comments):
            if b <= i and not self.s[b:i].strip():
                i = a
            else:
                break
        m = self._tail.search(self.s, max(0, i - 64), i)
        return m.group(1) if m else ""

    def regex(self, m) -> int:
        last = self.before(m.start())
        allowed = not last or last in self._words or last[-1] in "(,=:[!&|?{};+-*%~^<>" and last not in ("++", "--")
        if last == "}":
            allowed = True
        x = self._regex.match(self.s, m.start()) if allowed else None
        return x.end() if x else m.end()

    def template(self, m) -> int:
        part = re.compile(r"`|\\.|\$\{", re.S)
        i = m.end()
        while x := part.search(self.s, i):
            i = x.end()
            if x.group() == "`":
                return i
            if x.group() == "${":
                i = self.code(i, "}")
        return self.error("unterminated-string", m.start(), self.n)


class Jsx(JavaScript):
    """With elements: their text is no code, and {} in them is."""

    begin = JavaScript.begin + r"|(?P<element><(?=[A-Za-z>]))"

    #: what a list of type parameters begins with, where TSX has one before an arrow's parameters
    _types = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|=(?![=>])|extends\s+[^=>/\s])")

    def element(self, m) -> int:
        last = self.before(m.start())
        if self.dialect == "tsx" and self._types.match(self.s, m.start()):
            return m.end()
        if last and last not in self._words and last[-1] not in "(,=:[!&|?{};>" and last != "=>":
            return m.end()
        i, depth = m.start(), 0
        tag = re.compile(r"<(/?)([\w.:$-]*)|\{")
        while x := tag.search(self.s, i):
            if x.group() == "{":
                i = self.code(x.end(), "}")
                continue
            i, closed = self._tag(x.end(), m.start())
            if x.group(1):
                depth -= 1
            elif not closed:
                depth += 1
            if depth <= 0:
                return i
        return self.error("unterminated-jsx-element", m.start(), self.n)

    def _tag(self, i: int, a: int) -> tuple[int, bool]:
        part = re.compile(r"/>|>|\"[^\"]*\"|'[^']*'|\{|/\*.*?\*/|//[^\r\n]*", re.S)
        while x := part.search(self.s, i):
            i = x.end()
            t = x.group()
            if t in (">", "/>"):
                return i, t == "/>"
            if t == "{":
                i = self.code(i, "}")
            elif t[0] == "/":
                self.comment(x.start(), x.end(), "block" if t[1] == "*" else "line")
        self.error("unterminated-jsx-tag", a, self.n)
        return self.n, True


class Shell(Hash):
    begin = r"(?P<line>(?:(?<=[\s;|&()<>`])|(?<=\A))\#)|(?P<skip>\\.|\$\#|\$\{\#)|(?P<ansi>\$')|(?P<double>\$?\")|(?P<plain>')|(?P<heredoc><<(?!<)(?P<dash>-?)[ \t]*(?P<word>(?:\\.|'[^']*'|\"[^\"]*\"|[^\s;|&()<>'\"\\])+))|(?P<here3><<<)|(?P<sub>\$\()|(?P<param>\$\{)|(?P<newline>\n)|(?P<case>(?<![\w-])(?:case|esac)(?![\w-]))|(?P<bracket>[()])"
    here3 = Lexer.skip

    def __init__(self, text: str, dialect: str = "standard"):
        super().__init__(text, dialect)
        self.waiting: list[tuple[str, bool, int]] = []
        self.cases = 0

    def case(self, m) -> int:
        self.cases = max(0, self.cases + (1 if m.group() == "case" else -1))
        return m.end()

    def code(self, i: int, stop: str = "") -> int:
        if stop != ")":
            return super().code(i, stop)
        outer, self.cases = self.cases, 0
        self.depth += 1
        if self.depth > NESTING:
            self.errors.append(("nesting-limit", i, self.n))
            raise Stop
        opened = 0
        while m := self.next.search(self.s, i):
            if m.lastgroup == "bracket":
                i = m.end()
                if m.group() == "(":
                    opened += 1
                elif opened:
                    opened -= 1
                elif not self.cases:  # else it ends a pattern
                    break
                continue
            i = max(getattr(self, m.lastgroup)(m), m.start() + 1)
        else:
            i = self.n
        self.depth -= 1
        self.cases = outer
        return i

    def ansi(self, m) -> int:
        return self.quoted(m.start(), m.end(), "'", lines=True) if self.dialect in ("bash53", "zsh", "standard") else self.plain(m)

    def plain(self, m) -> int:
        return self.until(m.start(), m.end(), "'")

    def double(self, m) -> int:
        part = re.compile(r"\"|\\.|\$\(", re.S)
        i = m.end()
        while x := part.search(self.s, i):
            i = x.end()
            if x.group() == '"':
                return i
            if x.group() == "$(":
                i = self.code(i, ")")
        return self.error("unterminated-string", m.start(), self.n)

    def sub(self, m) -> int:
        return self.code(m.end(), ")")

    def param(self, m) -> int:
        part = re.compile(r"\}|\\.|'[^']*'|\"(?:\\.|[^\"\\])*\"|\$\{|\$\(", re.S)
        i, depth = m.end(), 1
        while x := part.search(self.s, i):
            i = x.end()
            t = x.group()
            if t == "}":
                depth -= 1
                if not depth:
                    return i
            elif t == "${":
                depth += 1
            elif t == "$(":
                i = self.code(i, ")")
        return m.end()

    def heredoc(self, m) -> int:
        word = re.sub(r"\\(.)|'([^']*)'|\"([^\"]*)\"", lambda x: x.group(1) or x.group(2) or x.group(3) or "", m.group("word"))
        self.waiting.append((word, bool(m.group("dash")), m.start()))
        return m.end()

    def newline(self, m) -> int:
        i = m.end()
        for word, tabs, a in self.waiting:
            end = re.compile(r"(?m:^)" + (r"\t*" if tabs else "") + re.escape(word) + r"(?=\r?\n|\Z)").search(self.s, i)
            if not end:
                self.waiting = []
                return self.error("unterminated-heredoc", a, self.n)
            i = end.end()
        self.waiting = []
        return i


class Yaml(Hash):
    begin = r"(?P<line>(?:(?<=[ \t\r\n])|(?<=\A))\#)|(?P<double>(?:(?<=[\s\[{,:-])|(?<=\A))\")|(?P<plain>(?:(?<=[\s\[{,:-])|(?<=\A))')|(?P<scalar>(?:(?<=[ \t:-])|(?<=\A))[|>][0-9+-]{0,2}(?=[ \t]*(?:[ \t]\#[^\r\n]*)?(?:\r?\n|\Z)))"

    def double(self, m) -> int:
        return self.quoted(m.start(), m.end(), '"', lines=True)

    def plain(self, m) -> int:
        return self.quoted(m.start(), m.end(), "'", lines=True, escape="", doubled=True)

    def scalar(self, m) -> int:
        begin = self.s.rfind("\n", 0, m.start()) + 1
        head = re.compile(r"[ ]*(?:- +)*").match(self.s, begin)
        owner = len(head.group()) - (len(head.group()) - len(head.group().rstrip("- ")) if head.group().strip() and not self.s[head.end() : m.start()].strip() else 0)
        if self.s[head.end() : m.start()].strip() == "":
            owner = head.group().rfind("-") if "-" in head.group() else -1
        digit = re.search(r"[1-9]", m.group())
        floor = owner + int(digit.group()) if digit else owner + 1
        rest = re.compile(r"[ \t]*(\#[^\r\n]*)?").match(self.s, m.end())
        if rest.group(1):
            self.comment(rest.start(1), rest.end(1), "line")
        i = self.s.find("\n", rest.end())
        if i < 0:
            return self.n
        i += 1
        body = re.compile(r"([ ]*)([^\r\n]*)(\r?\n|\Z)")
        while i < self.n:
            x = body.match(self.s, i)
            if x.group(2).strip() and (len(x.group(1)) < floor or len(x.group(1)) == 0 and x.group(2)[:3] in ("---", "...")):
                break
            i = x.end()
            if not x.group(3):
                break
        return max(i - 1, rest.end())  # the line break stays, so that a comment may follow it


class Html(Lexer):
    begin = r"(?P<markup><!--)|(?P<raw><(?P<tag>script|style)(?=[\s/>]))|(?P<element></?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>?)"
    flags = re.S | re.I
    scripts = {"": "javascript", "module": "javascript", "text/javascript": "javascript", "application/javascript": "javascript", "text/ecmascript": "javascript", "application/ecmascript": "javascript", "text/babel": "javascript", "text/jsx": "javascript", "text/typescript": "typescript", "application/typescript": "typescript"}

    def markup(self, m) -> int:
        a = m.start()
        end = self.s.find("-->", m.end())
        if end < 0:
            self.comment(a, self.n, "html-comment")
            return self.error("unterminated-comment", a, self.n)
        return self.comment(a, end + 3, "html-comment")

    def element(self, m) -> int:
        if not m.group().endswith(">"):
            self.error("unterminated-html-tag", m.start(), self.n)
            raise Stop
        return m.end()

    def language_of(self, tag: str, attributes: str) -> tuple[str, str] | None:
        kind = re.search(r"""\btype\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", attributes, re.I)
        kind = next((g for g in kind.groups() if g is not None), "").split(";")[0].strip().lower() if kind else ""
        if tag == "style":
            return ("css", "standard") if kind in ("", "text/css") else None
        language = self.scripts.get(kind)
        return (language, "standard") if language else None

    def raw(self, m) -> int:
        tag = m.group("tag").lower()
        head = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S).match(self.s, m.end())
        if not head:
            self.error("unterminated-html-tag", m.start(), self.n)
            raise Stop
        close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.s, head.end())
        end = close.start() if close else self.n
        if not close:
            self.error("unterminated-embedded-language", m.start(), self.n)
        found = self.language_of(tag, head.group())
        if found and not head.group().endswith("/>"):
            self.child(*found, head.end(), end)
        return end


class Vue(Html):
    def language_of(self, tag: str, attributes: str) -> tuple[str, str] | None:
        lang = re.search(r"""\blang\s*=\s*["']?([\w-]+)""", attributes, re.I)
        lang = lang.group(1).lower() if lang else ""
        if tag == "style":
            return {"": ("css", "standard"), "css": ("css", "standard"), "scss": ("css", "scss"), "sass": ("css", "sass"), "less": ("css", "scss")}.get(lang)
        return {"": ("javascript", "standard"), "js": ("javascript", "standard"), "ts": ("typescript", "standard"), "jsx": ("javascript", "jsx"), "tsx": ("typescript", "tsx")}.get(lang)


class VueFile(Vue):
    begin = Html.begin + r"|(?P<mustache>\{\{)"

    def mustache(self, m) -> int:
        end = self.s.find("}}", m.end())
        if end < 0:
            return m.end()
        self.child("javascript", "standard", m.end(), end)
        return end + 2


class Svelte(Vue):
    begin = Html.begin + r"|(?P<hole>\{)"

    def hole(self, m) -> int:
        inner = JavaScript(self.s)
        end = inner.code(m.end(), "}")
        self.comments += inner.comments
        self.errors += inner.errors
        return end


class Markdown(Lexer):
    begin = r"(?P<fence>(?m:^)(?P<indent>[ ]{0,3})(?P<mark>`{3,}(?=[^`\n]*$)|~{3,})(?P<info>[^\r\n]*))|(?P<indented>(?m:^)(?:[ ]{4}|\t)[^\r\n]*)|(?P<markup><!--)|(?P<ticks>`+)"
    flags = re.S | re.M

    markup = Html.markup
    indented = Lexer.skip

    def ticks(self, m) -> int:
        end = re.compile(r"(?<!`)" + m.group() + r"(?!`)").search(self.s, m.end())
        return end.end() if end and "\n\n" not in self.s[m.end() : end.start()] else m.end()

    def fence(self, m) -> int:
        mark = m.group("mark")
        body = self.s.find("\n", m.end())
        if body < 0:
            return self.n
        close = re.compile(rf"(?m:^)[ ]{{0,3}}{mark[0]}{{{len(mark)},}}[ \t]*(?=\r?$|\Z)", re.M).search(self.s, body + 1)
        end = close.start() if close else self.n
        word = re.match(r"\s*\{?\.?([\w+#-]*)", m.group("info")).group(1).lower()
        found = LANGUAGE_ALIASES.get(word)
        if found and found[0] not in ("html", "vue", "svelte", "markdown"):
            text, at = self.s[body + 1 : end], None
            if m.group("indent"):
                text, at = mapped(text, rf"(?m:^)[ ]{{1,{len(m.group('indent'))}}}", lambda x: "")
            comments, errors = scan_text(text, *found, embedded=True)
            where = (lambda x: body + 1 + x) if at is None else (lambda x: body + 1 + at[x])
            self.comments += [(where(a), where(b), k) for a, b, k in comments]
            self.errors += [(c, where(a), where(b)) for c, a, b in errors]
        return close.end() if close else self.n


class Php(Lexer):
    begin = r"(?P<line>//|\#(?!\[))|(?P<block>/\*)|(?P<close>\?>\n?)|(?P<multi>[\"'`])|(?P<heredoc><<<[ \t]*(?P<q>['\"]?)(?P<word>[A-Za-z_]\w*)(?P=q)\r?\n)"

    def run(self) -> None:
        i = 0
        if self.s.startswith("#!"):
            self.comment(0, self.to_line_end(0), "line")
        opened = re.compile(r"<\?(?:php(?=\s|\Z)|=|(?!xml))", re.I)
        try:
            while m := opened.search(self.s, i):
                i = self.code(m.end(), "?>")
        except Stop:
            pass

    def code(self, i: int, stop: str = "") -> int:
        while m := self.next.search(self.s, i):
            if m.lastgroup == "close":
                return m.end()
            i = max(getattr(self, m.lastgroup)(m), m.start() + 1)
        return self.n

    def line_kind(self, a: int) -> str:
        return "line"

    def block_kind(self, a: int) -> str:
        return "doc-block" if re.compile(r"/\*\*\s").match(self.s, a) else "block"

    def line(self, m) -> int:
        a, end = m.start(), self.to_line_end(m.start())
        close = self.s.find("?>", a, end)
        return self.comment(a, close if close >= 0 else end, "line")

    def heredoc(self, m) -> int:
        end = re.compile(rf"(?m:^)[ \t]*{m.group('word')}(?!\w)").search(self.s, m.end())
        return end.end() if end else self.error("unterminated-heredoc", m.start(), self.n)


class Ruby(Hash):
    begin = r"(?P<line>\#)|(?P<doc>(?m:^)=begin(?=\s))|(?P<data>(?m:^)__END__\r?$)|(?P<heredoc><<(?P<mode>[~-]?)(?P<q>['\"`]?)(?P<word>[A-Z_][A-Za-z0-9_]*)(?P=q))|(?P<char>\?(?:\\.|[^\s\w])(?!\w)|(?<![\w)\]}])\?\w(?!\w))|(?P<percent>(?<![\w)\]}.])%(?P<type>[qQwWiIrsx]?)(?P<open>[^\w\s=]))|(?P<regex>/)|(?P<text>[\"'`])|(?P<symbol>:\"|(?<![:\w]):[A-Za-z_]\w*[?!=]?)|(?P<newline>\n)|(?P<global>\$[^\s\w])|(?P<bracket>[{}])"
    flags = re.S | re.M
    char = Lexer.skip

    def __init__(self, text: str, dialect: str = "standard"):
        super().__init__(text, dialect)
        self.waiting: list[tuple[str, str, int]] = []

    def global_(self, m) -> int:
        return m.end()

    def __getattr__(self, name: str):
        if name == "global":
            return self.global_
        raise AttributeError(name)

    def doc(self, m) -> int:
        end = re.compile(r"(?m:^)=end(?:[ \t][^\n]*)?(?=\n|\Z)").search(self.s, m.end())
        if not end:
            self.comment(m.start(), self.n, "block")
            return self.error("unterminated-comment", m.start(), self.n)
        return self.comment(m.start(), end.end(), "block")

    def data(self, m) -> int:
        return self.n

    def symbol(self, m) -> int:
        return self._interpolated(m.start(), m.end(), '"', "", True) if m.group().endswith('"') else m.end()

    def text(self, m) -> int:
        return self.quoted(m.start(), m.end(), "'", lines=True) if m.group() == "'" else self._interpolated(m.start(), m.end(), m.group(), "", True)

    def regex(self, m) -> int:
        before = self.s[max(0, m.start() - 40) : m.start()]
        spaced = before[-1:].isspace() and not self.s[m.end() : m.end() + 1].isspace()
        last = before.rstrip()[-1:]
        word = re.search(r"(\w+)\s*\Z", before)
        keyword = word and word.group(1) in ("if", "unless", "when", "while", "until", "and", "or", "not", "return", "in", "puts", "then", "elsif")
        if not last or last in "(,=:[!&|?{};+-*%~^<>\n" or keyword or spaced and last not in ")]}" and not last.isdigit():
            return self._interpolated(m.start(), m.end(), "/", "", True)
        return m.end()

    def percent(self, m) -> int:
        o = m.group("open")
        close = {"(": ")", "[": "]", "{": "}", "<": ">"}.get(o, o)
        return self._interpolated(m.start(), m.end(), close, o if o != close else "", m.group("type") in ("", "Q", "W", "I", "r", "x"))

    def _interpolated(self, a: int, i: int, close: str, opener: str, holes: bool) -> int:
        part = re.compile(r"\\.|" + re.escape(close) + (("|" + re.escape(opener)) if opener else "") + (r"|#\{" if holes else ""), re.S)
        depth = 1
        while x := part.search(self.s, i):
            i = x.end()
            t = x.group()
            if t == "#{":
                i = self.code(i, "}")
            elif t == close:
                depth -= 1
                if not depth:
                    return i
            elif t == opener:
                depth += 1
        return self.error("unterminated-string", a, self.n)

    def heredoc(self, m) -> int:
        before = self.s[max(0, m.start() - 2) : m.start()].strip()
        if before and (before[-1].isalnum() or before[-1] in ")]}") and not m.group("mode"):
            return m.end()
        self.waiting.append((m.group("word"), m.group("mode"), m.start()))
        return m.end()

    def newline(self, m) -> int:
        i = m.end()
        for word, mode, a in self.waiting:
            end = re.compile(r"^" + (r"[ \t]*" if mode else "") + re.escape(word) + r"\r?$", re.M).search(self.s, i)
            if not end:
                self.waiting = []
                return self.error("unterminated-heredoc", a, self.n)
            i = end.end()
        self.waiting = []
        return i


class Perl(Hash):
    begin = r"(?P<pod>^=[A-Za-z]\w*)|(?P<data>^__(?:END|DATA)__\r?$)|(?P<line>(?<![$@%&\w{])\#|(?<=[{\s;])\#)|(?P<words>(?<![\w$@%&>-])(?P<op>q[qwrx]?|m|s|tr|y)(?![\w])(?:\s*(?P<open>[^\w\s,;=)]))(?!=?>))|(?P<heredoc><<(?P<tilde>~?)(?:\"(?P<w1>[^\"\n]*)\"|'(?P<w2>[^'\n]*)'|(?P<w3>[A-Za-z_]\w*)))|(?P<variable>[$@%]\W?\#?(?:\{|\w+)?)|(?P<regex>/)|(?P<multi>[\"'`])|(?P<newline>\n)"
    flags = re.S | re.M

    def __init__(self, text: str, dialect: str = "standard"):
        super().__init__(text, dialect)
        self.waiting: list[tuple[str, bool, int]] = []

    def variable(self, m) -> int:
        return m.start() + 2 if self.s[m.start() + 1 : m.start() + 2] in ('"', "'", "#", "/", "`") else m.start() + 1

    def pod(self, m) -> int:
        end = re.compile(r"^=cut\b[^\n]*", re.M).search(self.s, m.start())
        return end.end() if end else self.n

    def data(self, m) -> int:
        return self.n

    def words(self, m) -> int:
        i = self._delimited(m.start(), m.end(), m.group("open"))
        if m.group("op") in ("s", "tr", "y") and i < self.n:
            o = m.group("open")
            if o in "([{<":
                x = re.compile(r"\s*([^\w\s])").match(self.s, i)
                i = self._delimited(m.start(), x.end(), x.group(1)) if x else i
            else:
                i = self._delimited(m.start(), i, o)
        return i

    def _delimited(self, a: int, i: int, o: str) -> int:
        close = {"(": ")", "[": "]", "{": "}", "<": ">"}.get(o, o)
        part = re.compile(r"\\.|" + re.escape(close) + (("|" + re.escape(o)) if o != close else ""), re.S)
        depth = 1
        while x := part.search(self.s, i):
            i = x.end()
            if x.group() == close:
                depth -= 1
                if not depth:
                    return i
            elif x.group() == o:
                depth += 1
        return self.error("unterminated-string", a, self.n)

    def regex(self, m) -> int:
        before = self.s[max(0, m.start() - 40) : m.start()].rstrip()
        last = before[-1:]
        if last in ")]}" and last:
            self.error("lexical-ambiguity", m.start(), m.end())
            raise Stop
        word = re.search(r"([$@%]?\w+)\Z", before)
        if word and (word.group(1)[0] in "$@%" or word.group(1) not in ("if", "unless", "and", "or", "not", "split", "grep", "map", "join", "return", "push", "while", "until", "x", "lt", "gt", "eq", "ne")):
            return m.end()
        return self._delimited(m.start(), m.end(), "/")

    def heredoc(self, m) -> int:
        word = next(g for g in (m.group("w1"), m.group("w2"), m.group("w3")) if g is not None)
        self.waiting.append((word, bool(m.group("tilde")), m.start()))
        return m.end()

    newline = Shell.newline


class Unknown(Lexer):
    def run(self) -> None:
        self.error("unknown-language", 0, self.n)


LEXERS: dict[str, type[Lexer]] = {
    "rust": Rust, "ocaml": Ocaml, "c": C, "cpp": Cpp, "go": Go, "java": Java, "javascript": JavaScript, "typescript": JavaScript, "python": Python, "shell": Shell, "html": Html, "css": Css,
    "jsonc": Jsonc, "sql": Sql, "kotlin": Kotlin, "toml": Toml, "lua": Lua, "yaml": Yaml, "php": Php, "ruby": Ruby, "zig": Zig, "r": R, "dart": Dart, "swift": Swift, "csharp": CSharp,
    "scala": Scala, "markdown": Markdown, "perl": Perl, "vue": VueFile, "svelte": Svelte,
}
#: names that a fence may give
LANGUAGE_ALIASES = {
    **{n: (n, "standard") for n in LEXERS},
    **{a: (n, d) for n, d, names in (
        ("rust", "standard", "rs"), ("cpp", "standard", "c++ cc cxx hpp"), ("go", "standard", "golang"), ("javascript", "standard", "js mjs node"), ("javascript", "jsx", "jsx"),
        ("typescript", "standard", "ts"), ("typescript", "tsx", "tsx"), ("python", "standard", "py python3"), ("shell", "bash53", "bash"), ("shell", "posix-sh", "sh"), ("shell", "zsh", "zsh"),
        ("css", "scss", "scss"), ("css", "sass", "sass"), ("jsonc", "standard", "json json5"), ("kotlin", "standard", "kt"), ("yaml", "standard", "yml"), ("ruby", "standard", "rb"),
        ("csharp", "standard", "cs c#"), ("ocaml", "standard", "ml"), ("markdown", "standard", "md"), ("perl", "standard", "pl"),
    ) for a in names.split()},
}


def scan_text(text: str, language: str | None, dialect: str = "standard", embedded: bool = False) -> tuple[list[tuple[int, int, str]], list[tuple[str, int, int]]]:
    """(comments, errors) of a source read as ISO-8859-1."""
    lexer = LEXERS.get(language or "", Unknown)
    if dialect in ("jsx", "tsx"):
        lexer = Jsx
    at = None
    if language in ("c", "cpp") and "\\" in text:
        text, at = mapped(text, r"\\(?:\r\n|\n|\r)", lambda m: "")
    elif language == "java" and "\\u" in text:
        text, at = mapped(text, r"(?<!\\)(?:\\\\)*\\u+([0-9a-fA-F]{4})", lambda m: chr(min(int(m.group(1), 16), 255)))
    found = lexer(text, dialect)
    begin = 3 if not embedded and text.startswith("\xef\xbb\xbf") else 0
    found.run()
    comments = found.comments
    if not embedded and text.startswith("#!", begin) and language not in ("python", "shell", "ruby", "perl", "toml", "yaml", "r", "javascript", "typescript", "php", "lua", "dart"):
        if not any(a == begin for a, _, _ in comments) and language in ("swift", "scala", "csharp", "rust"):
            comments.insert(0, (begin, found.to_line_end(begin), "line"))
    if at is not None:
        comments = [(at[a], at[b], k) for a, b, k in comments]
        found.errors = [(c, at[a], at[b]) for c, a, b in found.errors]
    return sorted(comments), sorted(found.errors, key=lambda e: e[1:])


def scan(content: bytes | None, language: str | None, dialect: str | None = "standard") -> tuple[list[tuple[int, int, str]], list[tuple[str, int, int]]]:
    return scan_text((content or b"").decode("latin-1"), language, dialect or "standard")


# ---- declarative profiles --------------------------------------------------------------------------------------------------------


def check_profile(profile: dict) -> list[str]:
    """Why a profile can't be used; empty if it can."""
    wrong = []
    if not profile.get("name"):
        wrong.append("a profile needs a name")
    tokens = [x.get("start", "") for k in ("line_comments", "block_comments", "strings") for x in profile.get(k, [])]
    if not tokens:
        wrong.append("a profile needs a delimiter")
    if any(not t for t in tokens):
        wrong.append("a delimiter is not empty")
    if any("\n" in t or "\r" in t for t in tokens):
        wrong.append("a delimiter has no line break")
    if any(not x.get("end") for k in ("block_comments", "strings") for x in profile.get(k, [])):
        wrong.append("a block or string needs an end")
    if len(set(tokens)) < len(tokens):
        wrong.append("two delimiters begin alike")
    return wrong


def scan_profile(content: bytes, profile: dict) -> tuple[list[tuple[int, int, str]], list[tuple[str, int, int]]]:
    """Comments by a profile's delimiters: strings first, then the longest opener."""
    if wrong := check_profile(profile):
        raise ValueError("; ".join(wrong))
    s, n, i = content.decode("latin-1"), len(content), 0
    kinds = [("string", x) for x in profile.get("strings", [])]
    kinds += sorted([("block", x) for x in profile.get("block_comments", [])] + [("line", x) for x in profile.get("line_comments", [])], key=lambda k: -len(k[1]["start"]))
    begin = re.compile("|".join(re.escape(x["start"]) for _, x in sorted(kinds, key=lambda k: -len(k[1]["start"]))))
    comments, errors = [], []
    while m := begin.search(s, i):
        a = m.start()
        i = a + 1
        for kind, x in kinds:
            start = x["start"]
            if not s.startswith(start, a):
                continue
            if kind == "string":
                p = _quoted_pattern(x["end"], x.get("multiline", False), x.get("escape", ""))
                j = a + len(start)
                while True:
                    e = p.search(s, j)
                    if not e or e.group() in "\r\n":
                        i = e.start() if e else n
                        errors.append(("unterminated-profile-string", a, i))
                        break
                    if e.group() == x["end"]:
                        i = e.end()
                        break
                    j = e.end() + 1
                break
            if kind == "line":
                before = s[s.rfind("\n", 0, a) + 1 : a]
                if x.get("requires_line_start") and before.strip() or x.get("requires_boundary") and before and not before[-1].isspace():
                    continue
                if s[a + len(start) : a + len(start) + 1] and s[a + len(start)] in x.get("forbidden_after", ""):
                    continue
                i = Lexer.line_end.search(s, a).start()
                comments.append((a, i, x.get("kind", "line")))
                break
            depth, j, both = 1, a + len(start), re.compile(re.escape(start) + "|" + re.escape(x["end"]))
            while depth:
                e = both.search(s, j)
                if not e:
                    break
                j = e.end()
                depth += -1 if e.group() == x["end"] else int(x.get("nested", False))
            i = j if not depth else n
            comments.append((a, i, x.get("kind", "block")))
            if depth:
                errors.append(("unterminated-profile-comment", a, n))
            break
    if profile.get("doc_continuation"):
        for k in range(1, len(comments)):
            a, b, kind = comments[k]
            pa, pb, before = comments[k - 1]
            gap = s[pb:a]
            if kind == "line" and before == "doc-line" and not gap.strip() and gap.count("\n") == 1:
                comments[k] = (a, b, "doc-line")
    return comments, errors
