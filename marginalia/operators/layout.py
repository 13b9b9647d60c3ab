"""Edits for removed comments, their application, and maps between the two texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import as_bytes, latin
from marginalia.schema import LAYOUTS
from marginalia.session import ship, slices

_BLANK = " \t"
_ENDS = re.compile("\r\n|\r|\n|\xe2\x80[\xa8\xa9]")


def width(text: str, column: int = 0) -> int:
    """Display columns that a latin-1 text takes from a column on: tab stops of 8, wide characters 2, marks 0."""
    at = column
    try:
        text = text.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        pass
    for c in text:
        if c == "\t":
            at += 8 - at % 8
        elif unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Me", "Mn"):
            continue
        else:
            at += 2 if unicodedata.east_asian_width(c) in "WF" else 1
    return at - column


def line_edit(s: str, a: int, b: int, kind: str) -> tuple[int, int, str]:
    """The comment's line ends stay; a space stays where only the comment parted two words."""
    if kind == "html-comment":
        return a, b, ""
    ends = "".join(m.group() for m in _ENDS.finditer(s, a, b))
    apart = not ends and a > 0 and b < len(s) and not s[a - 1].isspace() and not s[b].isspace()
    return a, b, ends or (" " if apart else "")


def column_edit(s: str, a: int, b: int, kind: str) -> tuple[int, int, str]:
    """Spaces as wide as the comment, so what follows stays in its column."""
    if kind == "html-comment":
        return a, b, ""
    out, at = [], a
    begin = max(s.rfind("\n", 0, a), s.rfind("\r", 0, a)) + 1
    column = width(s[begin:a])
    for m in _ENDS.finditer(s, a, b):
        out += [" " * width(s[at : m.start()], column), m.group()]
        at, column = m.end(), 0
    return a, b, "".join(out) + " " * width(s[at:b], column)


def compact_edits(s: str, removed: list[tuple[int, int, str]], floor: int = 0) -> list[tuple[int, int, str]]:
    """A comment alone on its lines takes them along; one after code takes the blanks before it; one inside code leaves at most one
    blank. Where whole lines go between blank lines, only the smaller number of these stays."""
    out: list[tuple[int, int, str]] = []
    k = 0
    while k < len(removed):
        a, b, kind = removed[k]
        begin = max(s.rfind("\n", 0, a), s.rfind("\r", 0, a)) + 1
        m = _ENDS.search(s, b)
        end, after = (m.start(), m.end()) if m else (len(s), len(s))
        own = not s[max(begin, floor) : a].strip(_BLANK) and begin >= floor
        # other removed comments may share the line
        last = k
        while last + 1 < len(removed) and removed[last + 1][0] < end and not s[removed[last][1] : removed[last + 1][0]].strip(_BLANK):
            last += 1
            b = removed[last][1]
            m = _ENDS.search(s, b)
            end, after = (m.start(), m.end()) if m else (len(s), len(s))
        tail = not s[b:end].strip(_BLANK)
        if own and tail:
            edit = (begin, after, "")
        elif tail:
            start = a
            while start > floor and s[start - 1] in _BLANK:
                start -= 1
            edit = (start, end, "")
        else:
            before, behind = a, b
            while before > max(begin, floor) and s[before - 1] in _BLANK:
                before -= 1
            while behind < end and s[behind] in _BLANK:
                behind += 1
            ends = "".join(x.group() for x in _ENDS.finditer(s, a, b))
            keep = min(a - before, behind - b)
            glue = kind != "html-comment" and not (a - before) and not (behind - b) and a > 0 and b < len(s) and not s[a - 1].isspace() and not s[b].isspace()
            edit = (a, b + keep, ends or (" " if glue else "")) if not own else (a, behind, ends)
        if out and out[-1][1] == edit[0] and own and tail and not out[-1][2]:
            out[-1] = (out[-1][0], edit[1], "")
        else:
            out.append(edit)
        floor = edit[1]
        k = last + 1
    blank = re.compile(r"[ \t]*(?:\r\n|\r|\n)")
    for i, (a, b, text) in enumerate(out):
        if text or not (a == 0 or s[a - 1] in "\r\n"):
            continue
        above, at = 0, a
        while at > (out[i - 1][1] if i else 0):
            x = max(s.rfind("\n", 0, at - 1), s.rfind("\r", 0, at - 1)) + 1
            if s[x:at].strip() or x == at:
                break
            above, at = above + 1, x
        below, to = 0, b
        limit = out[i + 1][0] if i + 1 < len(out) else len(s)
        while (m := blank.match(s, to)) and m.end() <= limit:
            below, to = below + 1, m.end()
        if above and below or at == 0 and below:
            for _ in range(min(above, below) if above else below):
                m = blank.match(s, b)
                b = m.end()
            out[i] = (a, b, "")
    return out


def plan(s: str, removed: list[tuple[int, int, str]], layout: str) -> list[tuple[int, int, str]]:
    """Edits for the removed comments (start, end, kind) of a latin-1 source, sorted and apart from each other."""
    if layout == "compact":
        return compact_edits(s, removed)
    one = line_edit if layout == "lines" else column_edit
    return [one(s, a, b, kind) for a, b, kind in removed]


_EDIT = "array<struct<span_start:long,span_end:long,replacement:binary>>"


def plan_edits(decided: DataFrame, sources: DataFrame, layout: str = "lines", force_invalid: bool = False) -> DataFrame:
    """path, content, edits: of the established comments to remove, in the layout. A source with errors has no edits unless forced."""
    if layout not in LAYOUTS:
        raise ValueError(f"no layout {layout}")
    ship(sources.sparkSession)
    ok = (F.col("action") == "remove") & F.col("established") & (F.lit(force_invalid) | (F.size("errors") == 0))
    # a condition inside the aggregate, not a filter: the optimizer would derive constraints from the whole verdict
    per = decided.groupBy("path").agg(F.array_sort(F.collect_list(F.when(ok, F.struct("span_start", "span_end", "kind")))).alias("removed"))
    joined = sources.select("path", "content").join(per, "path", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("span_start", pa.int64()), ("span_end", pa.int64()), ("replacement", pa.binary())]))
        for batch in slices(batches, "content"):
            d = batch.to_pydict()
            out = []
            for content, removed in zip(d["content"], d["removed"], strict=True):
                s = (content or b"").decode("latin-1")
                edits = plan(s, [(r["span_start"], r["span_end"], r["kind"]) for r in removed or []], layout)
                out.append([{"span_start": a, "span_end": b, "replacement": t.encode("latin-1")} for a, b, t in edits])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["path", "content", "edits"])

    return joined.mapInArrow(rows, f"path string, content binary, edits {_EDIT}")


def apply_edits(content: Column, edits: Column) -> Column:
    """The content with sorted, disjoint edits in place; an edit that isn't in range or overlaps another is an error. Native."""
    source = latin(content)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("ok"))
    step = lambda s, e: F.struct(
        F.concat(s["out"], F.substring(source, (s["at"] + 1).cast("int"), (e["span_start"] - s["at"]).cast("int")), latin(e["replacement"])).alias("out"),
        e["span_end"].alias("at"),
        (s["ok"] & (e["span_start"] >= s["at"]) & (e["span_end"] >= e["span_start"]) & (e["span_end"] <= F.length(source))).alias("ok"),
    )
    done = lambda s: F.when(s["ok"], as_bytes(F.concat(s["out"], source.substr((s["at"] + 1).cast("int"), F.length(source))))).otherwise(F.raise_error(F.lit("edits overlap or are out of range")))
    return F.aggregate(edits, start, step, done)


def applied(plans: DataFrame) -> DataFrame:
    """Adds output and changed to path, content, edits."""
    out = plans.withColumn("output", apply_edits(F.col("content"), F.col("edits")))
    return out.withColumn("changed", F.col("output") != F.col("content"))


def source_map(plans: DataFrame) -> DataFrame:
    """Segments that cover both texts: what was kept is exact, what an edit replaced isn't."""
    zero = F.lit(0).cast("long")
    begin = F.struct(zero.alias("at"), zero.alias("to"), F.array().cast("array<struct<original_start:long,original_end:long,output_start:long,output_end:long,exact:boolean>>").alias("found"))
    cell = lambda a, b, c, d, exact: F.struct(a.alias("original_start"), b.alias("original_end"), c.alias("output_start"), d.alias("output_end"), F.lit(exact).alias("exact"))

    def step(s, e):
        gap = e["span_start"] - s["at"]
        to = s["to"] + gap
        new = F.octet_length(e["replacement"])
        kept = F.when(gap > 0, F.array(cell(s["at"], e["span_start"], s["to"], to, True))).otherwise(F.array().cast("array<struct<original_start:long,original_end:long,output_start:long,output_end:long,exact:boolean>>"))
        return F.struct(e["span_end"].alias("at"), (to + new).alias("to"), F.concat(s["found"], kept, F.array(cell(e["span_start"], e["span_end"], to, to + new, False))).alias("found"))

    def done(s):
        rest = F.octet_length("content") - s["at"]
        return F.when(rest > 0, F.concat(s["found"], F.array(cell(s["at"], s["at"] + rest, s["to"], s["to"] + rest, True)))).otherwise(s["found"])

    return plans.select("path", F.posexplode(F.aggregate("edits", begin, step, done)).alias("segment", "m")).select("path", "segment", "m.*")


def through(offsets: DataFrame, segments: DataFrame, reverse: bool = False) -> DataFrame:
    """offsets (path, offset) through a source map: inside a kept segment by its distance, inside an edit to its start, the end to the end."""
    a, b, c, d = ("output_start", "output_end", "original_start", "original_end") if reverse else ("original_start", "original_end", "output_start", "output_end")
    last = segments.groupBy("path").agg(F.max(b).alias("_n"), F.max(d).alias("_m"))
    hit = (F.col("offset") >= F.col(a)) & (F.col("offset") < F.col(b))
    j = offsets.join(segments, "path", "left").where(hit).select("path", "offset", F.when(F.col("exact"), F.col(c) + F.col("offset") - F.col(a)).otherwise(F.col(c)).alias("mapped"))
    ends = offsets.join(last, "path").where(F.col("offset") == F.col("_n")).select("path", "offset", F.col("_m").alias("mapped"))
    return j.union(ends)


def check_spans(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """External spans (path, span_start, span_end) with what is wrong with each: out-of-bounds, empty, unsorted, overlapping; null if nothing."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("seq")
    c = spans.join(sources.select("path", F.octet_length("content").cast("long").alias("_size")), "path")
    before = F.lag("span_end").over(w)
    start = F.lag("span_start").over(w)
    wrong = F.when((F.col("span_start") < 0) | (F.col("span_end") > F.col("_size")), "out-of-bounds").when(F.col("span_end") <= F.col("span_start"), "empty").when(F.col("span_start") < start, "unsorted").when(F.col("span_start") < before, "overlapping")
    return c.withColumn("problem", wrong).drop("_size")
