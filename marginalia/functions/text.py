"""Native expressions over comments and sources. Bytes are read as ISO-8859-1, one character for each, so positions are byte offsets."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import rules


def latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def as_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def utf8(content: Column) -> Column:
    """The bytes as text; what isn't UTF-8 is replaced."""
    return F.decode(content, "UTF-8") if not hasattr(F, "make_valid_utf8") else F.make_valid_utf8(content.cast("string"))


def fence(value: Column) -> Column:
    """The value itself, kept out of the optimizer's substitutions.

    Verdicts refer to kinds, reasons to verdicts and so on; put into each other, and into every constraint that a later filter asks for,
    they double with each step: planning takes minutes, and a pushed filter evaluates each part dozens of times for every row. What isn't
    deterministic stays where it is, and the condition always holds. (Not `rand() < 2`, which the optimizer knows to be true and removes.)
    """
    return F.when(F.spark_partition_id() >= 0, value)


def any_of(values: list[str]) -> str:
    """A pattern for the longest of these at a place."""
    return "|".join(re.escape(v) for v in sorted(values, key=lambda v: (-len(v), v)))


def comment_text(raw: Column) -> Column:
    """A comment without its opening and closing marks, the longest that fit."""
    inner = raw
    for mark in sorted(rules.OPENERS, key=len):  # the longest last, so outermost
        inner = F.when(raw.startswith(mark), F.substring(raw, F.lit(len(mark) + 1), F.length(raw))).otherwise(inner)
    out = inner
    for mark in sorted(rules.CLOSERS, key=len):
        out = F.when(inner.endswith(mark), F.substring(inner, F.lit(1), F.length(inner) - len(mark))).otherwise(out)
    return out


def contains_any(text: Column, values: list[str]) -> Column:
    return reduce(or_, [text.contains(v) for v in values])


def legal_marker(lower: Column) -> Column:
    return contains_any(lower, rules.LEGAL_MARKERS)


def opening_tag(text: Column) -> Column:
    """The upper-case word of at least two characters that the comment's text begins with, or null."""
    word = F.regexp_extract(text, r"^[\s*!\-/#]*([A-Z][A-Z0-9_]+)(?![\p{L}\p{N}])", 1)
    return F.when(word != "", word)


def line_of(latin_source: Column, offset: Column) -> Column:
    """The 1-based line of a byte offset; LF, CR and CRLF end a line, and an offset on the LF of a CRLF is still on its line."""
    before = F.substring(latin_source, F.lit(1), offset.cast("int"))
    ends = F.regexp_count(before, F.lit(r"\r\n|\r|\n"))
    split = before.endswith("\r") & (latin_source.substr(offset.cast("int") + 1, F.lit(1)) == "\n")
    return (ends + 1 - split.cast("int")).cast("long")


def column_of(latin_source: Column, offset: Column) -> Column:
    """The 1-based column in bytes."""
    before = F.substring(latin_source, F.lit(1), offset.cast("int"))
    return (F.length(F.regexp_extract(before, r"([^\r\n]*)\z", 1)) + 1).cast("long")


def code_before(latin_source: Column, start: Column) -> Column:
    """Does anything but ASCII white space come before this offset on its line? Only LF ends a line here."""
    before = F.substring(latin_source, F.lit(1), start.cast("int"))
    return F.regexp_extract(before, r"([^\n]*)\z", 1).rlike(r"[^ \t\n\r\f]")


def extension_label(path: Column) -> Column:
    """`.ext`, or the file's name where it has no extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when(ext != "", F.concat(F.lit("."), ext)).when(name == "", F.lit("<unnamed>")).otherwise(name)


def percent_encode(text: Column) -> Column:
    """Every byte but unreserved characters and / as %XX."""
    # url_encode writes a space as +, keeps * and encodes / and ~
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def annotation_escape(text: Column, is_property: bool = False) -> Column:
    """Escapes of a workflow command's data, or of its properties."""
    pairs = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")] + ([(":", "%3A"), (",", "%2C")] if is_property else [])
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def age_days(text: str | int) -> int:
    """`14d`, `2w`, or a number of days."""
    if isinstance(text, int):
        if text < 0:
            raise ValueError("an age is not negative")
        return text
    m = re.fullmatch(r"(\d+)([dw]?)", text.strip())
    if not m:
        raise ValueError(f"not an age: {text!r}")
    return int(m[1]) * (7 if m[2] == "w" else 1)


def glob_regex(glob: str) -> str:
    """A path glob as a Java regex: * and ? within a part, ** over parts, [..] and {a,b}."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out += "(?:[^/]+/)*"
            i += 3
            continue
        if glob.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]"
            i = end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out += "(?:" + "|".join(glob_regex(x) for x in glob[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out
