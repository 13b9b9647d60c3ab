"""Rewrites that move white space only: a blank after the marker, no blanks at line ends, paragraphs joined or one sentence to a line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import rules
from marginalia.functions.text import any_of
from marginalia.session import ship, slices

#: Words whose full stop ends no sentence.
ABBREVIATIONS = "e.g i.e etc vs cf al approx no fig eq sec vol pp dr mr mrs ms prof st".split()
_ENDERS, _CLOSERS = ".!?。！？", "\"')]}»”’」』"


def space_after_marker(raw: Column) -> Column:
    """A blank after the opening mark, unless a blank or ASCII punctuation is there."""
    return F.regexp_replace(raw, f"^({any_of(rules.OPENERS)})(?=[^\\s!-/:-@\\[-`{{-~])", "$1 ")


def trailing_whitespace(raw: Column) -> Column:
    """No blanks before a line's end; CRLF stays."""
    return F.regexp_replace(raw, r"[ \t]+(?=\r?\n|\z)", "")


def restyle(comments: DataFrame, space: bool = True, trailing: bool = True) -> DataFrame:
    """Adds style_rule (the first that changes the comment, or null) and replacement to comments that stay."""
    raw = F.col("raw")
    one = space_after_marker(raw) if space else raw
    two = trailing_whitespace(one) if trailing else one
    rule = F.when(F.lit(space) & (one != raw), "space-after-marker").when(F.lit(trailing) & (two != one), "trailing-whitespace")
    apply = (F.col("action") == "keep") & F.col("kind").isin("line", "block", "doc-line", "doc-block")
    return comments.withColumns({"style_rule": F.when(apply, rule), "replacement": F.when(apply & rule.isNotNull(), two)})


def sentences(text: str) -> list[str]:
    """The sentences of a paragraph. A full stop inside code marks or after an abbreviation ends none; closers stay with their sentence."""
    out, begin, i, code = [], 0, 0, False
    while i < len(text):
        c = text[i]
        if c == "`":
            code = not code
        elif c in _ENDERS and not code:
            j = i + 1
            while j < len(text) and text[j] in _ENDERS + _CLOSERS:
                j += 1
            word = re.search(r"([\w.]+)\Z", text[begin:i])
            short = c == "." and word and (word.group(1).lower() in ABBREVIATIONS or re.fullmatch(r"[A-Za-z]", word.group(1)))
            wide = c in "。！？"
            if not short and (wide or j >= len(text) or text[j].isspace()):
                out.append(text[begin:j].strip())
                begin = j
            i = j
            continue
        i += 1
    rest = text[begin:].strip()
    return [s for s in [*out, rest] if s]


_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+\S")
_PASS = re.compile(r"\s*(?:#{1,6}\s|>|\||={3,}|-{3,}|\*{3,}|`{3,}|~{3,}|\[[^\]]+\]:|</?[a-z])|\s{4,}\S", re.I)


def reflow(lines: list[str], wrap: str) -> list[str]:
    """A paragraph's lines joined (`unwrap`) or one sentence to a line (`sentence`). Headings, quotes, tables, rules, code and links pass;
    a list item takes along the lines that are indented under it."""
    if wrap == "preserve":
        return lines
    out: list[str] = []
    held: list[str] = []
    indent = ""

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join(x.strip() for x in held)
            parts = sentences(text) if wrap == "sentence" else [text]
            lead = re.match(r"\s*(?:(?:[-*+]|\d+[.)])\s+)?", held[0]).group()
            body = " " * len(lead) if lead.strip() else lead
            first = text[len(lead.strip()) :].strip() if lead.strip() else text
            parts = sentences(first) if wrap == "sentence" else [first]
            out.extend((lead if k == 0 else body) + p for k, p in enumerate(parts))
        held = []

    for line in lines:
        if not line.strip() or _PASS.match(line) and not held:
            flush()
            out.append(line)
        elif _ITEM.match(line):
            flush()
            held = [line]
        elif _PASS.match(line) and not line.startswith("    "):
            flush()
            out.append(line)
        else:
            held.append(line)
    flush()
    return out


def paragraphs(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The runs of lines that aren't blank: id, run, first_line, last_line, text. Windows by text."""
    lines = texts.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "value"))
    w = Window.partitionBy(id_col).orderBy("line")
    blank = F.col("value").rlike(r"^\s*$")
    marked = lines.withColumn("blank", blank).withColumn("run", F.sum(F.col("blank").cast("int")).over(w))
    grouped = marked.where("NOT blank").groupBy(id_col, "run").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("held"))
    return grouped.select(id_col, "run", (F.col("first_line") + 1).cast("long").alias("first_line"), (F.col("last_line") + 1).cast("long").alias("last_line"), F.expr("transform(held, x -> x.value)").alias("lines"))


def reflowed(runs: DataFrame, wrap: str = "sentence") -> DataFrame:
    """Adds reflowed (the lines after the rule) and changed to runs with lines."""
    ship(runs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "lines"):
            lines = batch.column(batch.schema.get_field_index("lines")).to_pylist()
            new = [reflow(x, wrap) for x in lines]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.list_(pa.string())), pa.array([a != b for a, b in zip(new, lines, strict=True)])], [*batch.schema.names, "reflowed", "changed"])

    from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

    schema = StructType([*runs.schema.fields, StructField("reflowed", ArrayType(StringType())), StructField("changed", BooleanType())])
    return runs.mapInArrow(rows, schema)
