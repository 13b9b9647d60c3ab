"""Registered queries over the given tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import rules
from marginalia.functions.text import column_of, latin, line_of
from marginalia.operators import lex, style
from marginalia.operators.classify import classify
from marginalia.operators.detect import detect, languages
from marginalia.operators.layout import applied, plan_edits, source_map
from marginalia.operators.shape import expire
from marginalia.operators.verdict import Options, decide
from marginalia.plans import analyse, reports
from marginalia.session import table
from marginalia.streaming.documents import accepted_versions

NOW = "2026-01-01 00:00:00"
EXPIRY = {"click": 30, "view": 60, "purchase": 90}


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"), F.lit("html").alias("language"), F.lit("standard").alias("dialect"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of each document as a line comment."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("n", "body")).select("doc_id", "source", "lang", (F.col("n") + 1).cast("long").alias("line"), "body")


def judged_lines(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    c = lines.select("doc_id", "source", "line", F.col("source").alias("path"), F.lit("c").alias("language"), latin(F.col("body").cast("binary")).alias("raw"), F.lit(0).cast("long").alias("span_start"), F.lit("line").alias("lexical_kind"))
    classified = classify(c.withColumnRenamed("source", "origin").withColumn("source", F.lit(""))).drop("source").withColumnRenamed("origin", "source")
    return decide(classified, Options(policy=policy))


def page_comment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = lex.html_comments(pages, "page_id", "html").groupBy("page_id").agg(F.count("*").alias("comments"), F.sum(F.col("span_end") - F.col("span_start")).alias("removed_bytes"))
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("comments", F.lit(0)).alias("comments"), F.coalesce("removed_bytes", F.lit(0)).alias("removed_bytes"))


def page_comment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex.html_comments(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", F.col("idx").cast("long").alias("idx"), "span_start", "span_end")


def page_comment_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.judge(page_sources(spark, sf_dir), Options(policy="all")).groupBy("kind", "action", "explanation").agg(F.count("*").alias("n"), F.sum(F.col("span_end") - F.col("span_start")).alias("bytes"))


def page_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analyse.transform(page_sources(spark, sf_dir), Options(policy="all"), "lines")
    return out.select(F.col("path").cast("long").alias("page_id"), F.octet_length("output").cast("long").alias("output_bytes"), F.md5("output").alias("output_md5"))


def page_source_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = page_sources(spark, sf_dir)
    segments = source_map(plan_edits(analyse.judge(sources, Options(policy="all")), sources, "lines"))
    return segments.groupBy("exact").agg(F.count("*").alias("segments"), F.sum(F.col("original_end") - F.col("original_start")).alias("original_bytes"), F.sum(F.col("output_end") - F.col("output_start")).alias("output_bytes"))


def embedded_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    body = lambda t: F.regexp_extract_all(html, F.lit(rf"(?s)<{t}(?:\s[^>]*)?>(.*?)</{t}>"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(body("script")).cast("long").alias("scripts"), F.size(body("style")).cast("long").alias("styles"), F.aggregate(body("script"), F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x)).alias("script_bytes"))


def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("path"), F.col("html").cast("binary").alias("content"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("path"), F.col("text").cast("binary").alias("content"))
    return detect(pages.union(docs)).groupBy("path", "language", "detected_by").agg(F.count("*").alias("files"))


def license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_lines(spark, sf_dir, "conservative").where("kind = 'license'").select("doc_id", "line", "action")


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row of a run over all pages, with the documents as skipped files."""
    sources = page_sources(spark, sf_dir)
    skipped = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.lit("unknown language").alias("reason"), F.lit(False).alias("error"))
    return analyse.summary(analyse.judge(sources, Options(policy="all")), sources, skipped)


def kind_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.kind_breakdown(judged_lines(spark, sf_dir, "conservative")).select("kind", "removable", "kept")


def kept_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.kept_for(judged_lines(spark, sf_dir, "conservative"))


def busiest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.busiest(judged_lines(spark, sf_dir, "standard"))


def ratchet_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count of license lines of each source against that of its toxic documents as the ledger."""
    recorded = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").groupBy(F.col("source").alias("path")).agg(F.count("*").alias("allowed"))
    found = judged_lines(spark, sf_dir, "standard").where("kind = 'license'").groupBy("path").agg(F.count("*").alias("allowed"))
    return analyse.drift(recorded, found)


def coverage_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("html").alias("language"), F.regexp_extract("url", r"^[^?#]*", 0).alias("path"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.lit("unknown language").alias("reason"), F.lit(False).alias("error"))
    c = analyse.coverage(pages.withColumn("path", F.regexp_extract("path", r"([^/]*)$", 1)), docs)
    return c.groupBy("state", "reader").agg(F.sum(F.when(F.col("extension").isNull(), F.col("files"))).alias("files"), F.sum(F.when(F.col("extension") == ".html", F.col("files")).otherwise(0)).alias("html_files"))


def tag_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that open a conversation's turn or a document's line, each taken for a line comment."""
    c = table(spark, sf_dir, "conversations").select("text").union(document_lines(spark, sf_dir).select("body"))
    return analyse.tag_inventory(c.select(latin(F.col("text").cast("binary")).alias("raw"), F.lit("line").alias("kind")))


def expired_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tagged lines with a date: an event's type is its tag, each type has a limit in days."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.lit(1).cast("long").alias("line"), F.col("ts").alias("commit_ts"), F.col("event_type").alias("tag"))
    c = e.select("path", "tag", F.lit("").alias("source"), F.lit(0).cast("long").alias("span_start"), F.lit("tagged").alias("shape"), F.lit("keep").alias("action"), F.lit("").alias("reason"), F.lit("tagged").alias("explanation"))
    judged = expire(c, e.select("path", "line", "commit_ts"), Options(policy="standard", expiry=EXPIRY), NOW)
    return judged.groupBy(F.col("tag").alias("event_type")).agg(F.count_if("expired").alias("expired"), F.max("age_days").cast("long").alias("oldest"), F.count("*").alias("lines"))


def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits: the user is the document, the event's number its version, its time the arrival."""
    a = accepted_versions(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", "event_id")
    return a.groupBy("user_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("stale"), F.max(F.when(F.col("accepted"), F.col("event_id"))).alias("version"))


def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "first_line", "last_line", F.size("lines").cast("long").alias("lines"))


def sentence_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = style.reflowed(style.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return runs.select("doc_id", "first_line", F.size("lines").alias("lines"), F.size("reflowed").alias("reflowed_lines"), "changed")


def trailing_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(style.trailing_whitespace(F.col("text"))).cast("long").alias("chars"))


def positions_of_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column, in bytes, of each text's first full stop."""
    d = table(spark, sf_dir, "documents").select("doc_id", latin(F.col("text").cast("binary")).alias("s"))
    d = d.withColumn("offset", (F.instr("s", ".") - 1).cast("long")).where("offset >= 0")
    return d.select("doc_id", "offset", line_of(F.col("s"), F.col("offset")).alias("line"), column_of(F.col("s"), F.col("offset")).alias("col"))


def established_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before a document's first `%%%` are certain, as before an error that spoils the rest."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.instr("text", "%%%").alias("at"))
    lines = d.select("doc_id", "at", F.posexplode(F.split("text", "\n")).alias("n", "body"))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ends = lines.withColumn("end", F.sum(F.length("body") + 1).over(w) - 1)
    errors = F.when(F.col("at") > 0, F.array(F.struct(F.lit("lexical-ambiguity").alias("code"), (F.col("at") - 1).cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end")))).otherwise(F.array().cast("array<struct<code:string,span_start:long,span_end:long>>"))
    c = lex.established(ends.select("doc_id", errors.alias("errors"), (F.col("end") - F.length("body")).alias("span_start"), F.col("end").alias("span_end")))
    return c.groupBy("doc_id").agg(F.count_if("established").alias("established"), F.count_if(~F.col("established")).alias("damaged"))


def unused_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Options(policy="standard", keep_regex=("Apache License", "zzzz no such text"), remove_regex=("Copyright",), keep_kinds=("license", "shebang"))
    lines = judged_lines(spark, sf_dir, "standard")
    return analyse.unused_settings(lines, o)


def page_report_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.jsonl(analyse.judge(page_sources(spark, sf_dir), Options(policy="all")))


def page_report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_results(analyse.judge(page_sources(spark, sf_dir), Options(policy="all")))


def page_report_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.annotations(analyse.judge(page_sources(spark, sf_dir), Options(policy="all")))


def page_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.diffs(applied(plan_edits(analyse.judge(page_sources(spark, sf_dir), Options(policy="all")), page_sources(spark, sf_dir), "compact")))


def page_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = page_sources(spark, sf_dir)
    o = Options(policy="all")
    return analyse.verify(analyse.transform(sources, o), sources, o).groupBy("problem").agg(F.count("*").alias("files"))


def page_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.advice(analyse.judge(page_sources(spark, sf_dir), Options(policy="all")))


def language_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark).select("language", F.concat_ws(" ", "extensions").alias("extensions"), F.concat_ws(" ", "dialects").alias("dialects"))


_ALL = (
    page_comment_counts, page_comment_spans, page_comment_verdicts, page_transform, page_source_map, embedded_regions, detected_languages, license_lines, page_summary, kind_breakdown,
    kept_reasons, busiest_sources, ratchet_drift, coverage_by_extension, tag_inventory, expired_promises, stream_versions, document_paragraphs, sentence_wrap, trailing_blanks,
    positions_of_stops, established_lines, unused_settings, page_report_jsonl, page_report_sarif, page_report_annotations, page_diffs, page_verify, page_advice, language_catalogue,
)
QUERIES = {f.__name__: f for f in _ALL}

_COMMENT = "'(?s)<!--.*?-->'"
_LEGAL = "'" + "|".join(rules.LEGAL_MARKERS) + "'"
_LINES = f"""lines AS (SELECT doc_id, source, unnest(ls) AS body, generate_subscripts(ls, 1)::BIGINT AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)),
judged AS (SELECT *, CASE WHEN regexp_matches(lower(body), {_LEGAL}) THEN 'license' ELSE 'line' END AS kind FROM lines)"""
_TAG = r"""nullif(regexp_extract({0}, '^[\s*!/#-]*([A-Z][A-Z0-9_]+)(?:$|[^\p{{L}}\p{{N}}A-Z0-9_])', 1), '')"""

ORACLE_SQL = {
    "page_comment_counts": f"SELECT page_id, len(c)::BIGINT AS comments, coalesce(list_sum(list_transform(c, lambda x: strlen(x))), 0)::BIGINT AS removed_bytes FROM (SELECT page_id, regexp_extract_all(html, {_COMMENT}) AS c FROM pages)",
    "page_comment_spans": f"""WITH t AS (SELECT page_id, regexp_extract_all(html, {_COMMENT}) AS c, string_split_regex(html, {_COMMENT}) AS p FROM pages),
        u AS (SELECT page_id, c, p, unnest(range(0, len(c))) AS idx FROM t),
        v AS (SELECT page_id, idx, c, (coalesce(list_sum(list_transform(p[1:idx + 1], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(c[1:idx], lambda x: strlen(x))), 0))::BIGINT AS span_start FROM u)
        SELECT page_id, idx::BIGINT AS idx, span_start, (span_start + strlen(c[idx + 1]))::BIGINT AS span_end FROM v""",
    "page_comment_verdicts": f"SELECT 'html-comment' AS kind, 'remove' AS action, 'removed-by-policy' AS explanation, count(*) AS n, sum(strlen(c))::BIGINT AS bytes FROM (SELECT unnest(regexp_extract_all(html, {_COMMENT})) AS c FROM pages)",
    "page_transform": f"SELECT page_id, strlen(o)::BIGINT AS output_bytes, md5(o) AS output_md5 FROM (SELECT page_id, regexp_replace(html, {_COMMENT}, '', 'g') AS o FROM pages)",
    "page_source_map": f"""WITH t AS (SELECT unnest(regexp_extract_all(html, {_COMMENT})) AS c FROM pages), k AS (SELECT unnest(string_split_regex(html, {_COMMENT})) AS p FROM pages)
        SELECT false AS exact, count(*) AS segments, sum(strlen(c))::BIGINT AS original_bytes, 0::BIGINT AS output_bytes FROM t
        UNION ALL SELECT true, count(*), sum(strlen(p))::BIGINT, sum(strlen(p))::BIGINT FROM k WHERE p != ''""",
    "embedded_regions": r"SELECT page_id, len(s)::BIGINT AS scripts, len(y)::BIGINT AS styles, coalesce(list_sum(list_transform(s, lambda x: strlen(x))), 0)::BIGINT AS script_bytes FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script(?:\s[^>]*)?>(.*?)</script>', 1) AS s, regexp_extract_all(html, '(?s)<style(?:\s[^>]*)?>(.*?)</style>', 1) AS y FROM pages)",
    "detected_languages": """SELECT path, CASE WHEN hit THEN 'html' END AS language, CASE WHEN hit THEN 'content' END AS detected_by, count(*) AS files
        FROM (SELECT 'page' AS path, contains(lower(html[1:4096]), '<html') OR contains(lower(html[1:4096]), '<!doctype html') AS hit FROM pages
        UNION ALL SELECT 'document', contains(lower(text[1:4096]), '<html') OR contains(lower(text[1:4096]), '<!doctype html') FROM documents) GROUP BY ALL""",
    "license_lines": f"WITH {_LINES} SELECT doc_id, line, 'keep' AS action FROM judged WHERE kind = 'license'",
    "page_summary": f"""SELECT count(*) AS files, count(*) FILTER (len(c) > 0) AS files_with_findings, 0::BIGINT AS files_invalid, 0::BIGINT AS kept, coalesce(sum(len(c)), 0)::BIGINT AS removable, coalesce(sum(len(c)), 0)::BIGINT AS removed,
        (SELECT count(*) FROM documents) AS skipped, 0::BIGINT AS io_errors FROM (SELECT regexp_extract_all(html, {_COMMENT}) AS c FROM pages)""",
    "kind_breakdown": f"WITH {_LINES} SELECT kind, count(*) FILTER (kind = 'line') AS removable, count(*) FILTER (kind != 'line') AS kept FROM judged GROUP BY kind",
    "kept_reasons": f"WITH {_LINES} SELECT 'conservative policy' AS reason, count(*) AS n FROM judged WHERE kind = 'license' HAVING count(*) > 0",
    "busiest_sources": f"WITH {_LINES} SELECT source AS path, count(*) AS removable FROM judged GROUP BY source ORDER BY removable DESC, path LIMIT 5",
    "ratchet_drift": f"""WITH {_LINES}, r AS (SELECT source AS path, count(*) AS allowed FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source),
        f AS (SELECT source AS path, count(*) AS found FROM judged WHERE kind = 'license' GROUP BY source)
        SELECT * FROM (SELECT coalesce(r.path, f.path) AS path, coalesce(allowed, 0) AS allowed, coalesce(found, 0) AS found,
        CASE WHEN found IS NULL THEN 'absent' WHEN found > coalesce(allowed, 0) THEN 'grew' WHEN found < allowed THEN 'shrank' END AS state FROM r FULL JOIN f ON r.path = f.path) WHERE state IS NOT NULL""",
    "coverage_by_extension": """SELECT 'scanned' AS state, 'html' AS reader, count(*) AS files, count(*) FILTER (regexp_matches(regexp_extract(url, '^[^?#]*'), '[^/.]\\.html$')) AS html_files FROM pages
        UNION ALL SELECT 'skipped', 'unknown language', count(*), 0 FROM documents""",
    "tag_inventory": f"""WITH {_LINES} SELECT tag, count(*) AS n FROM (SELECT {_TAG.format('text')} AS tag FROM conversations UNION ALL SELECT {_TAG.format('body')} FROM lines) WHERE tag IS NOT NULL GROUP BY tag""",
    "expired_promises": f"""WITH e AS (SELECT event_type, greatest(floor(epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))), 0)::BIGINT // 86400 AS age_days FROM events),
        l AS (SELECT *, CASE event_type WHEN 'click' THEN 30 WHEN 'view' THEN 60 WHEN 'purchase' THEN 90 END AS age_limit FROM e)
        SELECT event_type, count(*) FILTER (age_days > age_limit) AS expired, max(age_days)::BIGINT AS oldest, count(*) AS lines FROM l GROUP BY event_type""",
    "stream_versions": """WITH a AS (SELECT *, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events),
        b AS (SELECT *, before IS NULL OR event_id > before AS ok FROM a)
        SELECT user_id, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS stale, max(event_id) FILTER (ok) AS version FROM b GROUP BY user_id""",
    "document_paragraphs": f"""WITH {_LINES}, b AS (SELECT doc_id, line, NOT regexp_matches(body, '[^\\s]') AS blank FROM lines),
        r AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM b)
        SELECT doc_id, min(line) AS first_line, max(line) AS last_line, count(*) AS lines FROM r WHERE NOT blank GROUP BY doc_id, run""",
    "trailing_blanks": r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '[ \t]+(\r?\n)', '\1', 'g'), '[ \t]+$', ''))::BIGINT AS chars FROM documents",
    "positions_of_stops": """SELECT doc_id, strlen(p)::BIGINT AS "offset", (length(p) - length(replace(p, chr(10), '')) + 1)::BIGINT AS line, (strlen(regexp_extract(p, '[^\\n]*$')) + 1)::BIGINT AS col
        FROM (SELECT doc_id, text[1:instr(text, '.') - 1] AS p FROM documents WHERE instr(text, '.') > 0)""",
    "established_lines": f"""WITH {_LINES}, e AS (SELECT doc_id, line, sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS "end" FROM lines),
        a AS (SELECT doc_id, instr(text, '%%%') AS hit FROM documents)
        SELECT doc_id, count(*) FILTER (hit = 0 OR "end" <= hit - 1) AS established, count(*) FILTER (NOT (hit = 0 OR "end" <= hit - 1)) AS damaged FROM e JOIN a USING (doc_id) GROUP BY doc_id""",
    "unused_settings": f"""WITH {_LINES}, w AS (SELECT * FROM (VALUES ('keep_regex', 'Apache License'), ('keep_regex', 'zzzz no such text'), ('remove_regex', 'Copyright'), ('keep_kind', 'license'), ('keep_kind', 'shebang')) AS t(setting, value))
        SELECT setting, value FROM w WHERE NOT EXISTS (SELECT 1 FROM judged WHERE CASE WHEN setting LIKE '%regex' THEN contains(body, value) ELSE kind = value END)""",
    "page_verify": "SELECT 'comments left' AS problem, 0::BIGINT AS files WHERE false",
}
