"""Lexing as a table operator: sources in, comment and diagnostic rows out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import rules
from marginalia.functions.text import as_bytes, latin
from marginalia.operators.lexing import scan, scan_profile
from marginalia.session import ship, slices

_REPORT = "path string, content binary, language string, dialect string, comments array<struct<idx:int,span_start:long,span_end:long,lexical_kind:string>>, errors array<struct<code:string,span_start:long,span_end:long>>"
_COMMENT = pa.list_(pa.struct([("idx", pa.int32()), ("span_start", pa.int64()), ("span_end", pa.int64()), ("lexical_kind", pa.string())]))
_ERROR = pa.list_(pa.struct([("code", pa.string()), ("span_start", pa.int64()), ("span_end", pa.int64())]))


def reports(sources: DataFrame, profiles: dict[str, dict] | None = None, content: bool = True) -> DataFrame:
    """path, content (unless it isn't asked for), language, dialect with arrays of comments and errors: one row for each source, the source scanned once.

    A source whose language is `profile:<name>` is scanned by that declarative profile.
    """
    ship(sources.sparkSession)
    profiles = profiles or {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content"):
            d = batch.to_pydict()
            found = []
            for source, language, dialect in zip(d["content"], d["language"], d["dialect"], strict=True):
                if language and language.startswith("profile:"):
                    found.append(scan_profile(source or b"", profiles[language[8:]]))
                else:
                    found.append(scan(source, language, dialect))
            comments = [[{"idx": i, "span_start": a, "span_end": b, "lexical_kind": k} for i, (a, b, k) in enumerate(c)] for c, _ in found]
            errors = [[{"code": c, "span_start": a, "span_end": b} for c, a, b in e] for _, e in found]
            given = [n for n in batch.schema.names if content or n != "content"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in given), pa.array(comments, _COMMENT), pa.array(errors, _ERROR)], [*given, "comments", "errors"])

    return sources.select("path", F.col("content").cast("binary"), "language", "dialect").mapInArrow(rows, _REPORT if content else _REPORT.replace("content binary, ", ""))


def comments(report: DataFrame) -> DataFrame:
    """One row for each comment, with its bytes and what surrounds it; a narrow operation."""
    source = latin(F.col("content"))
    c = report.select("path", "language", "dialect", source.alias("source"), F.size("errors").alias("n_errors"), "errors", F.explode("comments").alias("c"))
    return c.select("path", "language", "dialect", "source", "errors", "c.*", F.substring("source", F.col("c.span_start").cast("int") + 1, (F.col("c.span_end") - F.col("c.span_start")).cast("int")).alias("raw"))


def diagnostics(report: DataFrame) -> DataFrame:
    return report.select("path", F.explode("errors").alias("e")).select("path", "e.code", F.lit("error").alias("severity"), "e.span_start", "e.span_end")


def established(comments: DataFrame) -> DataFrame:
    """Adds established: is the comment untouched by the damage of every error of its source?"""
    hit = F.exists("errors", lambda e: F.when(e["code"].isin(*rules.DAMAGE_REST), F.col("span_end") > e["span_start"]).otherwise((F.col("span_start") < e["span_end"]) & (F.col("span_end") > e["span_start"])))
    return comments.withColumn("established", ~hit)


def html_comments(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Markup comments of pages by native expressions only: every token of the page in turn, comments among them, and running byte offsets.

    A script's or style's body and a tag's quoted attributes are tokens of their own, so what looks like a comment there is none.
    """
    token = r"(?s)<!--.*?(?:-->|\z)|<(?i:script)(?=[\s/>])[^>]*+>.*?(?=</(?i:script)[\s/>]|\z)|<(?i:style)(?=[\s/>])[^>]*+>.*?(?=</(?i:style)[\s/>]|\z)|</?[A-Za-z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>?|[^<]++|<"
    tokens = F.regexp_extract_all(latin(F.col(html_col).cast("binary")), F.lit(token), F.lit(0))
    run = F.aggregate(
        tokens,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<span_start:long,span_end:long>>").alias("found")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t)).cast("long").alias("at"),
            F.when(t.startswith("<!--"), F.concat(s["found"], F.array(F.struct(s["at"].alias("span_start"), (s["at"] + F.length(t)).cast("long").alias("span_end"))))).otherwise(s["found"]).alias("found"),
        ),
        lambda s: s["found"],
    )
    return pages.select(id_col, F.posexplode(run).alias("idx", "c")).select(id_col, "idx", "c.span_start", "c.span_end")


__all__ = ["as_bytes", "comments", "diagnostics", "established", "html_comments", "reports"]
