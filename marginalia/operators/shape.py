"""Rules over a comment's surroundings: keep blocks, allowed tags, trailing comments, long runs, expired promises. Windows by source."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import rules
from marginalia.functions.text import code_before, comment_text, line_of
from marginalia.operators.verdict import Options, first_match, named_outright

def _by():
    return Window.partitionBy("path").orderBy("span_start")




def with_runs(comments: DataFrame) -> DataFrame:
    """Adds run: comments on consecutive lines without code or a blank line between them are one paragraph. Only LF ends a line here."""
    c = comments.withColumn("_end", F.lag("span_end").over(_by())).withColumn("_gap", F.expr("substring(source, cast(_end AS int) + 1, cast(span_start - _end AS int))"))
    breaks = F.col("_end").isNull() | F.col("_gap").rlike(r"[^ \t\n\r\f]") | (F.regexp_count("_gap", F.lit("\n")) > 1) | code_before(F.col("source"), F.col("span_start"))
    return c.withColumn("run", F.sum(breaks.cast("int")).over(_by().rowsBetween(Window.unboundedPreceding, 0))).drop("_end", "_gap")


def keep_blocks(comments: DataFrame, options: Options) -> DataFrame:
    """A keep pattern keeps the whole block around the comment it matches: comments of one kind, each on the line after the last (LF, CR or CRLF)."""
    if not options.keep_regex:
        return comments.withColumn("kept_by_pattern", F.lit(None).cast("int"))
    c = comments.withColumn("_end", F.lag("span_end").over(_by())).withColumn("_kind", F.lag("kind").over(_by()))
    gap = F.expr("substring(source, cast(_end AS int) + 1, cast(span_start - _end AS int))")
    joined = F.coalesce((F.col("_kind") == F.col("kind")) & ~gap.rlike(r"[^ \t\n\r\f]") & (F.regexp_count(gap, F.lit(r"\r\n|\r|\n")) == 1), F.lit(False))
    c = c.withColumn("_block", F.sum((~joined).cast("int")).over(_by().rowsBetween(Window.unboundedPreceding, 0)))
    lowest = F.min(first_match(F.col("raw"), options.keep_regex)).over(Window.partitionBy("path", "_block"))
    inherit = lowest.isNotNull() & ~named_outright(F.col("kind"), F.col("raw"), options)
    c = c.withColumn("kept_by_pattern", F.when(inherit, lowest))
    return _settle(c, F.col("kept_by_pattern").isNotNull(), "keep", "kept by keep_regex", "kept-by-regex-block").drop("_end", "_kind", "_block")


def _settle(c: DataFrame, when: Column, action: str, reason: str | Column | None, explanation: str) -> DataFrame:
    reason = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
    return c.withColumns(
        {
            "reason": F.when(when, reason).otherwise(F.col("reason")),
            "explanation": F.when(when, F.lit(explanation)).otherwise(F.col("explanation")),
            "action": F.when(when, F.lit(action)).otherwise(F.col("action")),
        }
    )


def matching_tag(text: Column, tags: tuple[str, ...]) -> Column:
    """The first of the tags that the comment's text opens with as a word, in any case."""
    body = F.upper(F.regexp_replace(text, r"^[\s*!\-/#]+", ""))
    out = F.lit(None).cast("string")
    for t in reversed(tags):
        out = F.when(body.rlike("^" + re.escape(t.upper()) + r"(?![\p{L}\p{N}])"), F.lit(t)).otherwise(out)
    return out


def shape(comments: DataFrame, options: Options) -> DataFrame:
    """Adds run, tag and shape to decided comments and settles action anew: keep blocks, then tags, then trailing comments, then long runs."""
    c = keep_blocks(with_runs(comments), options).withColumns({"tag": F.lit(None).cast("string"), "shape": F.lit(None).cast("string")})
    if options.policy == "none":
        return c
    reachable = F.col("kind").isin(*rules.SHAPED_KINDS) & F.col("kept_by_pattern").isNull() & ~named_outright(F.col("kind"), F.col("raw"), options)
    if options.every_tag:
        text = F.decode(F.encode(comment_text(F.col("raw")), "ISO-8859-1"), "UTF-8")
        c = c.withColumn("tag", F.when(F.col("action") == "remove", matching_tag(text, options.every_tag)))
        c = _settle(c, F.col("tag").isNotNull(), "keep", F.concat(F.lit("opens with "), F.col("tag")), "tagged")
        c = c.withColumn("shape", F.when(F.col("tag").isNotNull(), "tagged"))
    if options.trailing is False:
        c = c.withColumn("_hit", (F.col("action") == "keep") & reachable & code_before(F.col("source"), F.col("span_start")))
        c = _settle(c, F.col("_hit"), "remove", None, "trailing").withColumn("shape", F.when(F.col("_hit"), "trailing").otherwise(F.col("shape"))).drop("_hit")
    if options.max_lines is not None:
        w = Window.partitionBy("path", "run")
        c = c.withColumns({"_a": F.min("span_start").over(w), "_b": F.max("span_end").over(w)})
        lines = F.regexp_count(F.expr("substring(source, cast(_a AS int) + 1, cast(_b - _a AS int))"), F.lit("\n")) + 1
        c = c.withColumn("_hit", (lines > options.max_lines) & reachable)
        c = _settle(c, F.col("_hit"), "remove", None, "too-long").withColumn("shape", F.when(F.col("_hit"), "too-long").otherwise(F.col("shape"))).drop("_a", "_b", "_hit")
    return c


def expire(comments: DataFrame, blame: DataFrame, options: Options, now) -> DataFrame:
    """A kept tag with a limit is removed once its line is older. blame: path, line, commit_ts; a line without a date never expires, and a
    date to come is of today. Only tagged comments are joined."""
    if not options.limits:
        return comments.withColumns({"age_days": F.lit(None).cast("int"), "expired": F.lit(False)})
    limit = F.element_at(F.create_map(*[F.lit(x) for t, d in options.limits.items() for x in (t, d)]), F.col("tag"))
    dated = comments.withColumn("line", line_of(F.col("source"), F.col("span_start"))).withColumn("_limit", F.when(F.col("shape") == "tagged", limit))
    seconds = F.greatest(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("commit_ts").cast("timestamp")), F.lit(0))
    ages = blame.groupBy("path", "line").agg(F.max("commit_ts").alias("commit_ts")).select("path", "line", F.expr("true").alias("_known"), F.floor(seconds / 86400).cast("int").alias("age_days"))
    c = dated.join(ages, ["path", "line"], "left").withColumn("expired", F.coalesce(F.col("age_days") > F.col("_limit"), F.lit(False)))
    c = _settle(c, F.col("expired"), "remove", None, "expired").withColumn("shape", F.when(F.col("expired"), "expired").otherwise(F.col("shape")))
    return c.drop("_limit", "_known")
