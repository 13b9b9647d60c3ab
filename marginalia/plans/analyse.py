"""The whole analysis as one lazy plan, and the questions asked of its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import rules
from marginalia.functions.text import comment_text, extension_label, opening_tag
from marginalia.operators import lex
from marginalia.operators.classify import classify
from marginalia.operators.layout import applied, plan_edits
from marginalia.operators.shape import shape
from marginalia.operators.verdict import Options, decide
from marginalia.schema import KINDS


def judge(sources: DataFrame, options: Options | None = None, profiles: dict[str, dict] | None = None) -> DataFrame:
    """Every comment of the sources with its kind, verdict, reason and surroundings."""
    options = options or Options()
    found = lex.comments(lex.reports(sources, profiles))
    # one shuffle by source: every window of the rules after it works on this partitioning
    return lex.established(shape(decide(classify(found, options.own_prefixes).repartition("path"), options), options))


def transform(sources: DataFrame, options: Options | None = None, layout: str = "lines") -> DataFrame:
    """path, content, edits, output, changed."""
    options = options or Options()
    return applied(plan_edits(judge(sources, options), sources, layout, options.force_invalid))


def verify(outputs: DataFrame, sources: DataFrame, options: Options) -> DataFrame:
    """Outputs that still hold a comment to remove, or that don't read as their language any more: should be empty."""
    again = sources.select("path", "language", "dialect").join(outputs.where("changed").select("path", F.col("output").alias("content")), "path")
    left = judge(again, options).groupBy("path").agg(F.count_if(F.col("action") == "remove").alias("n")).where("n > 0").select("path", F.lit("comments left").alias("problem"))
    broken = lex.reports(again).where(F.size("errors") > 0).select("path", F.lit("invalid output").alias("problem"))
    return left.union(broken).distinct()


def summary(judged: DataFrame, sources: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: files scanned, with findings, invalid; comments kept, removable, removed; skips. Counted per file first, so the last step adds few rows."""
    per = judged.groupBy("path").agg(
        F.count_if(F.col("action") == "keep").alias("kept"),
        F.count_if(F.col("action") == "remove").alias("removable"),
        F.count_if((F.col("action") == "remove") & F.col("established")).alias("removed"),
        F.bool_or(F.size("errors") > 0).alias("invalid"),
    )
    all_files = sources.select("path").join(per, "path", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = all_files.agg(F.count("*").alias("files"), F.count_if(F.col("removable") > 0).alias("files_with_findings"), F.count_if("invalid").alias("files_invalid"), zero("kept"), zero("removable"), zero("removed"))
    if skipped is not None:
        out = out.crossJoin(skipped.agg(F.count_if(~F.col("error")).alias("skipped"), F.count_if("error").alias("io_errors")))  # one row each
    return out


def kind_breakdown(judged: DataFrame) -> DataFrame:
    """removable and kept by kind, in the kinds' order."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    return judged.groupBy("kind").agg(F.count_if(F.col("action") == "remove").alias("removable"), F.count_if(F.col("action") == "keep").alias("kept")).withColumn("kind_order", F.element_at(order, F.col("kind")))


def kept_for(judged: DataFrame) -> DataFrame:
    return judged.groupBy("reason").agg(F.count_if(F.col("action") == "keep").alias("n")).where("n > 0")


def busiest(judged: DataFrame, most: int = 5) -> DataFrame:
    """The files with the most removable comments: a report of the top few."""
    return ledger(judged).withColumnRenamed("allowed", "removable").orderBy(F.desc("removable"), "path").limit(most)


def coverage(scanned: DataFrame, skipped: DataFrame, not_walked: DataFrame | None = None) -> DataFrame:
    """state, reader (language, or reason), extension, files: with a row for each extension and one for all of a reader (extension null)."""
    parts = scanned.select(F.lit("scanned").alias("state"), F.col("language").alias("reader"), "path")
    parts = parts.union(skipped.select(F.when(F.col("error"), "io-error").otherwise("skipped"), F.when(F.col("error"), "error").otherwise(F.col("reason")), "path"))
    if not_walked is not None:
        parts = parts.union(not_walked.select(F.lit("not-walked"), "reason", "path"))
    by = parts.withColumn("extension", extension_label(F.col("path"))).groupBy("state", "reader", "extension").agg(F.count("*").alias("files"))
    return by.union(by.groupBy("state", "reader").agg(F.sum("files").alias("files")).select("state", "reader", F.lit(None).cast("string"), "files"))


def coverage_share(covered: DataFrame) -> DataFrame:
    """One row: scanned, files and the share in tenths of a percent (1000 of nothing)."""
    c = covered.where("extension IS NULL").agg(F.coalesce(F.sum(F.when(F.col("state") == "scanned", F.col("files"))), F.lit(0)).alias("scanned"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))
    return c.select("scanned", "files", F.when(F.col("files") == 0, F.lit(1000).cast("long")).otherwise(F.expr("scanned * 1000 div files")).alias("tenths_percent"))


def top_extensions(covered: DataFrame, most: int = 8) -> DataFrame:
    """The most frequent extensions of each reader and one row for the rest of them."""
    w = Window.partitionBy("state", "reader").orderBy(F.desc("files"), "extension")
    ranked = covered.where("extension IS NOT NULL").withColumn("rank", F.row_number().over(w))
    return ranked.groupBy("state", "reader", F.when(F.col("rank") <= most, F.col("extension")).alias("extension")).agg(F.sum("files").alias("files"))


def tag_inventory(judged: DataFrame) -> DataFrame:
    """How often a comment opens with which upper-case tag; commentary only."""
    text = F.decode(F.encode(comment_text(F.col("raw")), "ISO-8859-1"), "UTF-8")
    tag = F.when(F.col("kind").isin(*rules.COMMENTARY_KINDS), opening_tag(text))
    return judged.groupBy(tag.alias("tag")).agg(F.count(tag).alias("n")).where("n > 0")


def tags_off_list(inventory: DataFrame, options: Options) -> DataFrame:
    """Tags that are configured and unused, and tags in use that aren't configured."""
    spark = inventory.sparkSession
    known = spark.createDataFrame([(t.upper(),) for t in options.every_tag], "tag string")
    unused = known.join(inventory, "tag", "left_anti").select("tag", F.lit("unused").alias("state"), F.lit(0).cast("long").alias("n"))
    return unused.union(inventory.join(known, "tag", "left_anti").select("tag", F.lit("unconfigured"), "n"))


def ledger(judged: DataFrame) -> DataFrame:
    """path, allowed: the removable comments of each file that has any."""
    return judged.groupBy("path").agg(F.count_if(F.col("action") == "remove").alias("allowed")).where("allowed > 0")


def drift(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """path, allowed, found, state (grew, shrank, absent) of files whose count isn't as recorded. recorded, found: path, allowed."""
    j = recorded.join(found.withColumnRenamed("allowed", "found"), "path", "full")
    state = F.when(F.col("found").isNull(), "absent").when(F.col("found") > F.coalesce("allowed", F.lit(0)), "grew").when(F.col("found") < F.col("allowed"), "shrank")
    return j.withColumn("state", state).where("state IS NOT NULL").select("path", F.coalesce("allowed", F.lit(0)).alias("allowed"), F.coalesce("found", F.lit(0)).alias("found"), "state")


def overdue(judged: DataFrame) -> DataFrame:
    return judged.where("expired").groupBy("tag").agg(F.count("*").alias("n"))


def unused_settings(judged: DataFrame, options: Options) -> DataFrame:
    """Patterns and kinds of the options that no comment met."""
    spark = judged.sparkSession
    want, used = [], []
    for name, patterns in (("keep_regex", options.keep_regex), ("remove_regex", options.remove_regex)):
        want += [(name, p) for p in patterns]
        if patterns:
            # each pattern for itself: one that never matches first is still in use if it matches
            hits = F.explode(F.array(*[F.when(F.col("raw").rlike(p), F.lit(p)) for p in patterns]))
            used.append(judged.select(F.lit(name).alias("setting"), hits.alias("value")))
    for name, kinds in (("keep_kind", options.keep_kinds), ("remove_kind", options.remove_kinds)):
        want += [(name, k) for k in kinds]
        if kinds:
            used.append(judged.where(F.col("kind").isin(*kinds)).select(F.lit(name).alias("setting"), F.col("kind").alias("value")))
    known = spark.createDataFrame(want, "setting string, value string")
    for u in used:
        known = known.join(u.where("value IS NOT NULL").distinct(), ["setting", "value"], "left_anti")
    return known


def advice(judged: DataFrame) -> DataFrame:
    """Removable comments by what to do about them, the most frequent first: files and comments of each decision."""
    text = F.decode(F.encode(comment_text(F.col("raw")), "ISO-8859-1"), "UTF-8")
    tag = opening_tag(text)
    code = text.rlike(r"[;{}]\s*$|^\s*(?:if|for|while|return|import|def|let|const|var)\b.*[({;=]|^\s*\w+\s*\([^)]*\)\s*;?\s*$")
    trailing = F.regexp_extract(F.expr("substring(source, 1, cast(span_start AS int))"), r"([^\n]*)\z", 1).rlike(r"[^ \t\r\f]")
    rest = F.expr("substring(source, cast(span_end AS int) + 1)")
    opens = rest.rlike(r"\A\s*+(?:pub|fn|def|class|function|func|struct|enum|interface|public|private|static|export|type|module|impl|trait)\b")
    decision = (
        F.when(F.col("shape").isNotNull(), F.col("shape"))
        .when(F.col("kind").isin("doc-line", "doc-block", "license"), "gentler-policy")
        .when(tag.isNotNull(), "promise")
        .when(trailing, "trailing-code")
        .when(code, "commented-code")
        .when(opens, "document-item")
        .when(F.regexp_replace(F.expr("substring(source, 1, cast(span_start AS int))"), r"\s", "") == "", "file-head")
        .otherwise("among-statements")
    )
    found = judged.withColumn("decision", F.when(F.col("action") == "remove", decision))
    # per file first: the number of files is then a count of rows, not of distinct values
    per = found.groupBy("decision", "path").agg(F.count_if(F.col("action") == "remove").alias("c"))
    return per.groupBy("decision").agg(F.sum("c").alias("comments"), F.count_if(F.col("c") > 0).alias("files")).where("comments > 0").orderBy(F.desc("comments"), "decision")
