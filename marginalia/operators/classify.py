"""Comment kinds beyond the lexical: shebang, encoding, hints, licenses, pinned actions, directives. One CASE chain, no Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import rules
from marginalia.functions.text import any_of, comment_text, contains_any, fence, legal_marker


def _ordered(values: list[str]) -> str:
    return "|".join(re.escape(v) for v in values)


def _found(text: Column, pattern: Column) -> Column:
    """What the pattern's first group finds, or null."""
    out = F.call_function("regexp_extract", text, pattern, F.lit(1))
    return F.when(out != "", out)


def _own_patterns() -> dict[str, str]:
    """For each language one pattern of the beginnings and whole words that its tools read."""
    out = {}
    for name in sorted({*rules.DIRECTIVES, *rules.DIRECTIVE_KEYWORDS}):
        parts = []
        if rules.DIRECTIVES.get(name):
            parts.append(f"(?:{_ordered(rules.DIRECTIVES[name])})")
        if rules.DIRECTIVE_KEYWORDS.get(name):
            parts.append(f"(?:{_ordered(rules.DIRECTIVE_KEYWORDS[name])})(?![A-Za-z0-9_-])")
        out[name] = f"^({'|'.join(parts)})"
    return out


def directive(lower: Column, raw: Column, language: Column) -> Column:
    """The directive that a comment is, or null. lower: its trimmed lower-case text; raw: its bytes as ISO-8859-1."""
    compact = F.ltrim(lower, F.lit("!/*#@ "))
    mise = F.when(raw.startswith("#") | raw.startswith("//"), F.regexp_extract(raw, r"^(?:#|//)\s*(?:\[(MISE|USAGE)\]|(MISE|USAGE)(?=\s|$))", 0))
    mise = F.when(mise.contains("MISE"), "MISE").when(mise.contains("USAGE"), "USAGE")
    biome = F.when(contains_any(lower, rules.SUPPRESSIONS), F.regexp_extract(lower, r"(?m)^[\s*]*(" + any_of(rules.SUPPRESSIONS) + r")(?=[\s:(/]|$)", 1))
    common = f"^((?:{_ordered(rules.COMMON_DIRECTIVES)})|(?:{_ordered(rules.COMMON_KEYWORDS)})(?![A-Za-z0-9_-]))"
    found = F.coalesce(mise, F.when(biome != "", biome), _found(compact, F.lit(common)))
    own = _found(compact, F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _own_patterns().items() for x in pair]), language), F.lit("^((?!))")))
    special = (
        F.when((language == "go") & raw.rlike(r"^(?://|/\*)go:"), "go:")
        .when((language == "go") & raw.rlike(r"^(?://|/\*)line "), "line ")
        .when((language == "typescript") & raw.startswith("///") & compact.startswith("<"), "///")
        .when(language.isin("typescript", "javascript") & compact.rlike(r"^webpack[a-z0-9]+:"), "webpack")
        .when((language == "lua") & raw.startswith("---@diagnostic"), "---@diagnostic")
        .when((language == "yaml") & lower.rlike(r"^@schema(?![A-Za-z0-9_-])"), "@schema")
        .when((language == "php") & lower.rlike(r"^@psalm-suppress(?![A-Za-z0-9_-])"), "@psalm-suppress")
        .when((language == "php") & lower.startswith("@phpstan-ignore"), "@phpstan-ignore")
        .when((language == "php") & lower.startswith("@codecoverageignore"), "@codeCoverageIgnore")
        .when((language == "zig") & raw.rlike(r"^//(?![/!])") & lower.isin("zig fmt: off", "zig fmt: on"), "zig fmt:")
        .when((language == "dart") & raw.rlike(r"^// *@dart *= *\d+\.\d+ *$"), "@dart")
        .when((language == "dart") & raw.rlike(r"^// dart format (?:off|on)\s*$"), "dart format")
        .when((language == "swift") & compact.rlike(r"^swift-format-ignore(?:-file)?(?=[:\s]|$)"), "swift-format-ignore")
        .when((language == "csharp") & lower.rlike(r"<auto-?generated"), "<auto-generated")
        .when((language == "csharp") & compact.rlike(r"^resharper[ \t]+(?:disable|restore)"), "ReSharper")
        .when((language == "csharp") & raw.rlike(r"^// csharpier-ignore(?:-start|-end)?$"), "csharpier-ignore")
        .when((language == "scala") & compact.isin("format: off", "format: on"), "format:")
        .when((language == "scala") & compact.rlike(r"^> using(?:[ \t]|$)"), "//> using")
    )
    return F.coalesce(found, special, own)


def load_bearing(name: Column, language: Column) -> Column:
    out = name.isin("MISE", "USAGE")
    for known, names in sorted(rules.LOAD_BEARING.items()):
        out = out | ((language == known) & name.isin(*names))
    return out


#: A pinned action before a comment that names its version, in YAML.
_PIN = r"^\s*(?:-\s+)?[\"']?uses[\"']?\s*:\s*[\"']?[^\s\"'@]+@(?:[0-9a-f]{40}|[0-9a-f]{64})[\"']?\s+$"
_PINNED = r"^#\s*(?:pin@|tag=|tag:\s*|ratchet:\S*@)?v?[0-9][A-Za-z0-9.+_-]*(?:\s.*)?$|^#\s*(?:main|master|stable|release/\S+)\s*$"


def classify(comments: DataFrame, own_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Adds kind and directive to rows of path, language, source, span_start, raw, lexical_kind. Comments that begin with one of the caller's own
    prefixes (a tool's name and a colon, in lower case) are directives of every language."""
    raw, language, at = F.col("raw"), F.col("language"), F.col("span_start").cast("int")
    lower = F.trim(F.lower(F.decode(F.encode(comment_text(raw), "ISO-8859-1"), "UTF-8")))
    before = F.substring("source", F.lit(1), at)
    line_before = F.regexp_extract(before, r"([^\r\n]*)\z", 1)
    bom = F.when(F.col("source").startswith("ï»¿"), 3).otherwise(0)
    line_only = F.regexp_replace(line_before, "^ï»¿", "").rlike(r"^[ \t\f]*$")
    early = F.regexp_count(before, F.lit(r"\r\n|\r|\n")) < 2
    encoding = language.isin("python", "ruby") & raw.startswith("#") & early & line_only & raw.rlike(r"coding[:=][ \t]*[A-Za-z0-9._-]")
    out = comments.withColumn("_lower", fence(lower)).withColumn("directive", fence(F.coalesce(*(F.when(F.col("_lower").startswith(p), p) for p in own_prefixes), directive(F.col("_lower"), raw, language))))
    pin = (language == "yaml") & F.regexp_replace(line_before, "^ï»¿", "").rlike(_PIN) & raw.rlike(_PINNED)
    kind = (
        F.when((at == bom) & raw.startswith("#!"), "shebang")
        .when(encoding, "encoding")
        .when((language == "sql") & raw.startswith("/*+"), "optimizer-hint")
        .when((language == "sql") & raw.startswith("/*!"), "version-comment")
        .when(legal_marker(F.col("_lower")), "license")
        .when(pin, "directive")
        .when(F.col("directive").isNotNull() & load_bearing(F.col("directive"), language), "load-bearing")
        .when(F.col("directive").isNotNull(), "directive")
        .otherwise(F.col("lexical_kind"))
    )
    return out.withColumn("kind", fence(kind)).drop("_lower")
