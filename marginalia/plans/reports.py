"""Reports and sinks: JSON lines, SARIF results, annotations, human lines, diffs, ledgers, exit code."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import annotation_escape, column_of, line_of, percent_encode
from marginalia.session import ship, slices


def positions(judged: DataFrame) -> DataFrame:
    """Adds line and column (1-based, in bytes)."""
    return judged.withColumns({"line": line_of(F.col("source"), F.col("span_start")), "column": column_of(F.col("source"), F.col("span_start"))})


def findings(judged: DataFrame) -> DataFrame:
    """The comments that don't stay, with line and column. Gathered by source and spread again: a plain filter would have the optimizer
    carry the whole verdict into its constraints, which takes minutes to plan."""
    columns = ["span_start", "span_end", "kind", "action", "explanation", "raw", "line", "column"]
    per = positions(judged).groupBy("path").agg(F.collect_list(F.when(F.col("action") != "keep", F.struct(*columns))).alias("found"))
    return per.select("path", F.explode("found").alias("f")).select("path", "f.*")


def preview(raw, most: int = 60):
    """A comment on one line: white space folded, controls replaced, cut with an ellipsis."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.decode(F.encode(raw, "ISO-8859-1"), "UTF-8"), r"\s+", " "), r"[\p{Cc}\p{Cf}]", "�"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def human(judged: DataFrame) -> DataFrame:
    p = findings(judged)
    return p.select("path", "span_start", F.format_string("%s:%d:%d: %s %s (%s): %s", "path", "line", "column", "action", "kind", "explanation", preview(F.col("raw"))).alias("text"))


def jsonl(judged: DataFrame) -> DataFrame:
    """A line for each file with its comments in order."""
    one = F.struct("span_start", "span_end", "line", "column", "kind", "action", "reason", "explanation")
    per = positions(judged).groupBy("path", "language").agg(F.array_sort(F.collect_list(one)).alias("comments"))
    return per.select("path", F.to_json(F.struct("path", "language", "comments")).alias("value"))


def sarif_results(judged: DataFrame) -> DataFrame:
    """A SARIF result for each finding; a run is these between a head and a foot."""
    p = findings(judged)
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.col("span_start").alias("byteOffset"), (F.col("span_end") - F.col("span_start")).alias("byteLength"))
    where = F.struct(F.struct(F.struct(percent_encode(F.col("path")).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.concat(F.lit("comment/"), F.col("kind")).alias("ruleId"), F.lit("note").alias("level"), F.struct(F.concat(F.lit("removable "), F.col("kind"), F.lit(" comment")).alias("text")).alias("message"), F.array(where).alias("locations"))
    return p.select("path", "span_start", F.to_json(result).alias("value"))


def annotations(judged: DataFrame) -> DataFrame:
    """A workflow command for each finding."""
    p = findings(judged)
    head = F.format_string("::notice file=%s,line=%d,col=%d::", annotation_escape(F.col("path"), True), "line", "column")
    return p.select("path", "span_start", F.concat(head, annotation_escape(F.concat(F.lit("removable "), F.col("kind"), F.lit(": "), preview(F.col("raw"))))).alias("value"))


def diffs(transformed: DataFrame, context: int = 3) -> DataFrame:
    """A unified diff for each changed file; a file without a final line break is marked so."""
    ship(transformed.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content", "output"):
            d = batch.to_pydict()
            out = []
            for path, a, b in zip(d["path"], d["content"], d["output"], strict=True):
                lines = difflib.unified_diff(a.decode("latin-1").splitlines(True), b.decode("latin-1").splitlines(True), f"a/{path}", f"b/{path}", n=context)
                out.append("".join(x if x.endswith(("\n", "\r")) else x + "\n\\ No newline at end of file\n" for x in lines).encode("latin-1", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["path", "diff"])

    return transformed.where("changed").select("path", "content", "output").mapInArrow(rows, "path string, diff binary")


def write_ledger(counts: DataFrame, path: str) -> None:
    """`<count> <path>` lines, sorted by path."""
    counts.orderBy("path").select(F.concat_ws(" ", F.col("allowed").cast("string"), "path").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_ledger(spark, path: str) -> DataFrame:
    """path, allowed of a ledger; empty lines and # comments are no entries."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(?:#|$)"))
    return lines.select(F.regexp_extract("value", r"^\s*\d+ (.*)$", 1).alias("path"), F.regexp_extract("value", r"^\s*(\d+) ", 1).cast("long").alias("allowed"))


def exit_code(summary: DataFrame, deny_findings: bool = True) -> DataFrame:
    """One row: 2 if a file is invalid, 1 if something is left to decide, else 0."""
    return summary.select(F.when(F.col("files_invalid") > 0, 2).when(F.lit(deny_findings) & (F.col("removable") > 0), 1).otherwise(0).alias("code"))


def trace(judged: DataFrame) -> DataFrame:
    """The decisions as JSON events; a rewrite is told as a keep."""
    return judged.select("path", "span_start", F.to_json(F.struct(F.lit("decision").alias("event"), "path", "span_start", "span_end", "kind", F.when(F.col("action") == "remove", "remove").otherwise("keep").alias("action"), "explanation")).alias("value"))
