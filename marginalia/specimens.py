"""Queries that hold the lexers, classification, rules and layouts against stated expectations.

Each language has a program written here; every document's text is set into its strings and comments, so the lexers read the whole documents
table and the place of each comment follows from the lengths of the pieces, which SQL can say. The other queries judge small stated sources.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import rules
from marginalia.functions.text import age_days, glob_regex, percent_encode
from marginalia.operators import lex
from marginalia.operators.classify import classify
from marginalia.operators.detect import detect
from marginalia.operators.layout import applied, plan_edits, source_map, through
from marginalia.operators.shape import expire
from marginalia.operators.style import space_after_marker
from marginalia.operators.verdict import Options, decide
from marginalia.plans import analyse
from marginalia.schema import KINDS, POLICIES
from marginalia.session import table

#: What can't stand in a string, and what can't stand in a comment, of any of the languages; a blank takes its place.
NOT_IN_STRINGS = r"""[\x00-\x1f\x7f"'\\`$@#%{}()<>\[\]|~&^=+\x{85}\x{2028}\x{2029}]"""
NOT_IN_COMMENTS = r"""[\x00-\x1f\x7f\\*/<>{}()\[\]?=\x{85}\x{2028}\x{2029}-]"""
LEXICAL = {"L": "line", "B": "block", "D": "doc-line", "E": "doc-block", "H": "html-comment"}

#: language, dialect, program: comments in ⟦kind|...⟧, §s a text fit for strings, §c one fit for comments.
PROGRAMS = [
    ("rust", "standard", 'let a = "// §s"; ⟦B|/* a /* b */ §c */⟧ let r = r#"/* "no */ §s"#; fn f<\'a>(x: &\'a str) { let q = \'"\'; } ⟦D|/// §c⟧\n⟦L|// §c⟧'),
    ("c", "standard", 'char *s = "/* §s"; char q = \'"\'; ⟦B|/* §c */⟧ int a = b / c; ⟦L|// §c \\\n§c⟧\nint d;'),
    ("cpp", "standard", 'auto s = R"x(// §s )" no)x"; ⟦L|// §c⟧\nauto n = 1\'000\'000; ⟦B|/* §c\n */⟧'),
    ("go", "standard", "s := `// §s`; q := '\"' ⟦L|// §c⟧\nt := \"/* §s\" ⟦B|/* §c */⟧\n"),
    ("java", "standard", 'String s = """\n // §s\n"""; ⟦E|/** §c */⟧ char q = \'"\'; ⟦L|// §c⟧\n'),
    ("javascript", "standard", "let r = /\\/\\/ no/g; let d = a / b; ⟦L|// §c⟧\nlet t = `// §s ${ f(⟦B|/* §c */⟧ 1) } // §s`; let u = '/* §s'; ⟦L|// §c⟧"),
    ("javascript", "jsx", "const a = <p title='// §s'>// text {⟦B|/* §c */⟧ 1}</p>; ⟦L|// §c⟧"),
    ("typescript", "standard", "let a: string = '// §s'; ⟦B|/* §c */⟧ type T = `// §s`; ⟦L|// §c⟧\n"),
    ("typescript", "tsx", "const f = <T,>(x: T) => x ⟦L|// §c⟧\nconst g = <p>// text {⟦B|/* §c */⟧ 1}</p>;\n"),
    ("python", "standard", "s = '# §s'; t = '''\n# §s\n'''; ⟦L|# §c⟧\nu = r\"\\# §s\" ⟦L|# §c⟧"),
    ("shell", "bash53", "echo a#b '# §s' \"# §s $(x ⟦L|# in⟧\n)\" ⟦L|# §c⟧\ncat <<EOF\n# §s\nEOF\n⟦L|# §c⟧\n"),
    ("html", "standard", "<a title='<!-- §s'>§s⟦H|<!-- §c -->⟧<script>let a = '// §s'; ⟦L|// §c⟧\n</script><style>⟦B|/* §c */⟧</style><textarea>⟦H|<!-- §s -->⟧</textarea>"),
    ("css", "standard", "a { b: url(//x); c: \"/* §s\" } ⟦B|/* §c */⟧ "),
    ("css", "scss", "a { b: \"// §s\" } ⟦L|// §c⟧\n⟦B|/* §c */⟧\n"),
    ("jsonc", "standard", '{"a": "// §s", ⟦B|/* §c */⟧ "b": 1} ⟦L|// §c⟧'),
    ("sql", "standard", "select '-- §s', \"/* §s\" ⟦L|-- §c⟧\n⟦B|/* §c */⟧"),
    ("sql", "postgresql", "select $x$ -- §s $x$, e'\\' -- §s' ⟦B|/* a /* b */ §c */⟧ ⟦L|-- §c⟧\n"),
    ("sql", "mysql", "select 1--1, '# §s' ⟦L|# §c⟧\n⟦L|-- §c⟧"),
    ("sql", "oracle", "select q'[ -- ' §s ]' from d ⟦L|-- §c⟧"),
    ("kotlin", "standard", 'val s = "// §s ${ f("}") ⟦B|/* in */⟧ } §s" ⟦B|/* a /* §c */ */⟧ ⟦L|// §c⟧\n'),
    ("toml", "standard", "a = '# §s' ⟦L|# §c⟧\nb = \"\"\"\n# §s\"\"\" ⟦L|# §c⟧"),
    ("lua", "standard", "s = [==[ -- §s ]==] ⟦B|--[[ §c\n]]⟧ x = '-- §s' ⟦L|-- §c⟧\n"),
    ("yaml", "standard", "a: 'x # §s' ⟦L|# §c⟧\nb: |\n  # §s\nc: d#no\n⟦L|# §c⟧"),
    ("php", "standard", "// text §s <?php $a = '// §s'; ⟦L|// §c⟧\n⟦L|# §c⟧\n#[Attr]\n$b = <<<X\n// §s\nX;\n⟦B|/* §c */⟧ ?> // §s"),
    ("ruby", "standard", "a = '# §s'; b = \"#{c ⟦L|# in⟧\n}\" ⟦L|# §c⟧\n⟦B|=begin\n§c\n=end⟧\nd = %w(# no)\nputs <<~X ⟦L|# §c⟧\n  # §s\nX\n"),
    ("zig", "standard", "const a = \"// §s\";\nconst b =\n    \\\\// §s\n; ⟦D|/// §c⟧\n⟦L|// §c⟧"),
    ("r", "standard", "a <- '# §s'; b %# no% c; r\"(# §s)\" ⟦L|# §c⟧\n"),
    ("dart", "standard", "var a = r'// §s'; var b = '${ x ⟦B|/* in */⟧ }'; ⟦B|/* a /* §c */ */⟧ ⟦D|/// §c⟧"),
    ("swift", "standard", 'let a = #"// §s \\#( x ⟦B|/* in */⟧ )"#; ⟦B|/* a /* §c */ */⟧ ⟦L|// §c⟧'),
    ("csharp", "standard", 'var a = @"// §s"""; var b = $"{x ⟦B|/* in */⟧}"; var c = """ // §s """; ⟦L|// §c⟧'),
    ("scala", "standard", 'val a = s"${ x ⟦B|/* in */⟧ }"; val b = """// §s"""; val e = <a>// §s</a> ⟦B|/* a /* §c */ */⟧ ⟦L|// §c⟧'),
    ("ocaml", "standard", "let a = \"(* §s *)\" and c = '\"' and q = {x|(* §s|x} ⟦B|(* a (* b *) \"*)\" §s *)⟧"),
    ("markdown", "standard", "`<!-- §s -->` ⟦H|<!-- §c -->⟧\n\n```python\nx = '# §s' ⟦L|# §c⟧\n```\n\n    <!-- code -->\n"),
    ("perl", "standard", "my $a = q(# §s); my $n = $#a; ⟦L|# §c⟧\n=pod\n# §c\n=cutlery\n# §c\n=cut\n⟦L|# §c⟧"),
    ("vue", "standard", "<template>{{ a ⟦B|/* §c */⟧ }}</template><script lang='ts'>let s = '// §s'; ⟦L|// §c⟧\n</script>⟦H|<!-- §c -->⟧"),
    ("svelte", "standard", "{a ⟦B|/* §c */⟧}<script>let s = '// §s'; ⟦L|// §c⟧\n</script>⟦H|<!-- §c -->⟧"),
]


def pieces(program: str) -> list[tuple[str, str]]:
    """(lexical kind or nothing, text) of a program's parts in order."""
    parts = re.split(r"⟦(\w)\|(.*?)⟧", program, flags=re.S)
    out = []
    for i in range(0, len(parts), 3):
        out.append(("", parts[i]))
        if i + 2 < len(parts):
            out.append((LEXICAL[parts[i + 1]], parts[i + 2]))
    return out


def _program(program: str, inside: dict[str, Column]) -> Column:
    return F.concat(*[inside[p] if p in inside else F.lit(p) for p in re.split("(§[sc])", "".join(t for _, t in pieces(program))) if p])


def _lexer(language: str, dialect: str, program: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        inside = {"§s": F.regexp_replace(text, NOT_IN_STRINGS, " "), "§c": F.regexp_replace(text, NOT_IN_COMMENTS, " ")}
        sources = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), _program(program, inside).cast("binary").alias("content"), F.lit(language).alias("language"), F.lit(dialect).alias("dialect"))
        span = lambda c: F.concat_ws("-", c["lexical_kind"], c["span_start"], c["span_end"])
        return lex.reports(sources, content=False).select(F.col("path").cast("long").alias("doc_id"), F.array_join(F.transform("comments", span), ",").alias("spans"), F.size("errors").cast("long").alias("errors"))

    query.__doc__ = f"Spans of the comments of a {language} program with each document in its strings and comments."
    return query


def _lexer_sql(program: str) -> str:
    def size(text: str) -> str:
        return f"{len(re.sub('§[sc]', '', text).encode())} + {text.count('§s')} * strlen(s) + {text.count('§c')} * strlen(c)"

    spans, before = [], ""
    for kind, text in pieces(program):
        if kind:
            spans.append(f"'{kind}-' || ({size(before)})::VARCHAR || '-' || ({size(before + text)})::VARCHAR")
        before += text
    quote = lambda p: p.replace("'", "''")
    return f"""SELECT doc_id, concat_ws(',', {', '.join(spans)}) AS spans, 0::BIGINT AS errors FROM (SELECT doc_id,
        regexp_replace(coalesce(text, ''), '{quote(NOT_IN_STRINGS)}', ' ', 'g') AS s, regexp_replace(coalesce(text, ''), '{quote(NOT_IN_COMMENTS)}', ' ', 'g') AS c FROM documents)"""


def _sources(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """rows: path, language, text"""
    return spark.createDataFrame([(p, bytearray(t.encode()), g, "standard") for p, g, t in rows], "path string, content binary, language string, dialect string")


def _values(columns: str, rows: list[tuple]) -> str:
    def cell(x) -> str:
        if isinstance(x, bool) or x is None:
            return {True: "true", False: "false", None: "NULL"}[x]
        if isinstance(x, int):
            return f"{x}::BIGINT"
        return " || ".join(f"'{p}'" if i == 0 else f"chr(10) || '{p}'" for i, p in enumerate(x.replace("'", "''").split("\n")))

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


#: path, language, text, kinds of its comments in order
CLASSIFIED = [
    ("bang", "shell", "#!/bin/sh\n# coding: x", "shebang line"),
    ("coding", "python", "#!/usr/bin/python\n# -*- coding: utf-8 -*-\n# coding: late", "shebang encoding line"),
    ("hints", "sql", "/*+ hint */ /*! version */ -- plain", "optimizer-hint version-comment line"),
    ("legal", "c", "// Copyright 2020 x\n// SPDX-License-Identifier: MIT\n/* @preserve */", "license license license"),
    ("build", "go", "//go:build linux\n// +build x\n// go:build prose\n//nolint", "load-bearing load-bearing line directive"),
    ("bundler", "javascript", "import(/* webpackChunkName: 'x' */ y) // webpackish prose\n/* @vite-ignore */ /*#__PURE__*/ // eslint-disable-line", "load-bearing line load-bearing load-bearing directive"),
    ("reference", "typescript", '/// <reference path="x" />\n// @ts-ignore', "load-bearing directive"),
    ("lint", "python", "# pylint: disable\n# noqa\n# pylint\n# shellcheck disable=x\n# shellchecker", "directive directive line directive line"),
    ("frozen", "ruby", "# frozen_string_literal: true\n# rubocop:disable X", "load-bearing directive"),
    ("tasks", "shell", "# syntax=docker/x\n# hadolint ignore=y\n#MISE depends=z\n# mise prose", "load-bearing directive load-bearing line"),
    ("fmt", "zig", "// zig fmt: off\n// zig fmt: off please", "directive line"),
    ("tools", "swift", "// swift-tools-version:5.3\n// swift-format-ignore\n// swift-format-ignored", "load-bearing directive line"),
    ("using", "scala", "//> using dep x\n//> usingless", "load-bearing line"),
    ("pins", "yaml", "- uses: a/b@0000000000000000000000000000000000000000 # v1.2\n- uses: a/b@v1 # v1.2", "directive line"),
    ("docs", "rust", "/// a\n//// b\n//! c\n/** d */\n/*** e */\n/**/\n/*! f */", "doc-line line doc-line doc-block block block doc-block"),
]


def classified_specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the comments of stated sources."""
    found = classify(lex.comments(lex.reports(_sources(spark, [r[:3] for r in CLASSIFIED]))))
    return found.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_start", "kind"))), lambda x: x["kind"]), " ").alias("kinds"))


def policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind under every policy, with and without force."""
    kinds = spark.createDataFrame([(k, "x") for k in KINDS], "kind string, raw string")
    out = [decide(kinds, Options(policy=p, force_protected=force)).select("kind", F.lit(p).alias("policy"), F.lit(force).alias("forced"), "action") for p in POLICIES for force in (False, True)]
    while len(out) > 1:
        out = [out[i].union(out[i + 1]) for i in range(0, len(out), 2)]
    return out[0]


_KEEPS = ", ".join(f"('{p}', '{k}')" for p in POLICIES for k in rules.POLICY_KEEPS[p])
_GUARDS = ", ".join(f"'{k}'" for k in rules.PROTECTION)
_GRID = f"""WITH k AS (SELECT unnest([{', '.join(f"'{k}'" for k in KINDS)}]) AS kind), p AS (SELECT unnest([{', '.join(f"'{p}'" for p in POLICIES)}]) AS policy), f AS (SELECT unnest([false, true]) AS forced),
    keeps AS (SELECT * FROM (VALUES {_KEEPS}) AS t(policy, kind)),
    g AS (SELECT kind, policy, forced, kind IN ({_GUARDS}) AS guarded, (policy, kind) IN (SELECT (policy, kind) FROM keeps) AS listed FROM k, p, f)
    SELECT kind, policy, forced, CASE WHEN guarded AND NOT forced OR listed AND NOT (forced AND guarded AND policy != 'none') THEN 'keep' ELSE 'remove' END AS action FROM g"""

#: name, options, source (C), explanations of its comments in order
SHAPED = [
    ("tags", Options(policy="standard", tags=("note",)), "int a; // trailing\n// NOTE: kept\n// NOTEBOOK\n", "removed-by-policy tagged removed-by-policy"),
    ("long", Options(policy="standard", tags=("one", "two", "three", "t", "x"), max_lines=2, trailing=False), "int a; // t\n\n// one\n// two\n// three\n\n// x", "trailing too-long too-long too-long tagged"),
    ("none", Options(policy="none", tags=("one",), trailing=False, max_lines=1), "int a; // t\n// one\n// two", "kept-by-policy kept-by-policy kept-by-policy"),
    ("block", Options(policy="all", keep_regex=("TODO",)), "// TODO a\n// plain\n\n// far", "kept-by-regex kept-by-regex-block removed-by-policy"),
    ("kinds", Options(policy="all", keep_kinds=("line",)), "// a\n/* b */", "kept-by-kind removed-by-policy"),
    ("removed", Options(policy="none", remove_regex=("b",), remove_kinds=("block",)), "// a\n\n// b\n\n/* c */", "kept-by-policy removed-by-regex removed-by-kind"),
]


def shaped_specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations after the rules over surroundings, one set of options for each source."""
    out = None
    for name, options, text, _ in SHAPED:
        judged = analyse.judge(_sources(spark, [(name, "c", text)]), options)
        row = judged.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_start", "explanation"))), lambda x: x["explanation"]), " ").alias("explanations"))
        out = row if out is None else out.union(row)
    return out


#: layout, source (C), source without its comments
LAID_OUT = [
    ("lines", "a/* x */b", "a b"), ("lines", "a /* x\ny */ b", "a \n b"), ("lines", "// x\na\n", "\na\n"), ("columns", "a /* x */ b", "a         b"),
    ("compact", "a\n// x\nb\n", "a\nb\n"), ("compact", "a // x\nb\n", "a\nb\n"), ("compact", "a /* x */ b", "a b"), ("compact", "a/* x */b", "a b"),
    ("compact", "a\n\n// x\n\nb\n", "a\n\nb\n"), ("compact", "  // x\n  // y\nb", "b"), ("lines", "a /* open", "a /* open"),
]


def layout_specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stated sources become under each layout; one with an error stays as it is."""
    out = None
    for layout in ("lines", "columns", "compact"):
        sources = _sources(spark, [(str(i), "c", text) for i, (name, text, _) in enumerate(LAID_OUT) if name == layout])
        done = analyse.transform(sources, Options(policy="all"), layout).select(F.lit(layout).alias("layout"), F.col("content").cast("string").alias("source"), F.col("output").cast("string").alias("output"))
        out = done if out is None else out.union(done)
    return out


def mapped_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of a source carried through its source map."""
    one = _sources(spark, [("f", "c", "a /* x */ b")])
    segments = source_map(plan_edits(analyse.judge(one, Options(policy="all")), one, "lines"))
    return through(spark.createDataFrame([("f", o) for o in (0, 1, 3, 10, 11)], "path string, offset long"), segments).select("path", "offset", F.col("mapped").cast("long").alias("mapped"))


def verified_specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that still hold what had to go, or don't read any more: one of three here."""
    sources = _sources(spark, [("left", "c", "int a; // b"), ("good", "c", "int a; // b"), ("broken", "c", "int a; // b")])
    output = F.when(F.col("path") == "left", "int a; /* c */").when(F.col("path") == "good", "int a; ").otherwise("int a = \"open\n;")
    return analyse.verify(sources.select("path", "content", output.cast("binary").alias("output"), F.lit(True).alias("changed")), sources, Options(policy="all"))


#: path, content, language, dialect, what told
DETECTED = [
    ("a.PY", "", "python", "standard", "extension"), ("Dockerfile", "", "shell", "posix-sh", "reserved-filename"), ("x/run", "#!/usr/bin/env -S python3.11 -u\n", "python", "standard", "shebang"),
    ("run2", "#!/bin/bash -e\n", "shell", "bash53", "shebang"), ("page", "<!DOCTYPE html>", "html", "standard", "content"), ("none", "text", None, None, None), ("b.tsx", "", "typescript", "tsx", "extension"),
    ("c.rs", "#!/bin/sh\n", "rust", "standard", "extension"), ("d/e.go", "", "go", "standard", "extension"), ("f.kt", "", "kotlin", "standard", "extension"), ("g.lua", "", "lua", "standard", "extension"),
]


def detected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([(p, bytearray(c.encode())) for p, c, *_ in DETECTED], "path string, content binary")
    return detect(files).select("path", "language", "dialect", "detected_by")


def expired_specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with limits against the ages of their lines."""
    options = Options(policy="standard", expiry={"TODO": "10d", "NOTE": 5})
    judged = analyse.judge(_sources(spark, [("f", "c", "// TODO old\n// TODO new\n// NOTE undated\n// plain")]), options)
    blame = spark.createDataFrame([("f", 1, "2025-01-01 00:00:00"), ("f", 2, "2025-01-20 00:00:00"), ("f", 3, None)], "path string, line long, commit_ts string").withColumn("commit_ts", F.to_timestamp("commit_ts"))
    return expire(judged, blame, options, "2025-01-25 00:00:00").select(F.col("line").cast("long").alias("line"), "tag", "action", "expired")


def scalar_specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over stated values."""
    ages = spark.createDataFrame([("age", x, str(age_days(x))) for x in ("14d", "2w")], "function string, argument string, value string")
    df = spark.createDataFrame([("a b*~é",), ("x/y",)], "x string")
    encoded = df.select(F.lit("percent").alias("function"), F.col("x").alias("argument"), percent_encode(F.col("x")).alias("value"))
    globs = spark.createDataFrame([("src/a/b/c.py",), ("a/b.py",), ("src/x.rs",)], "x string")
    matched = globs.select(F.lit("glob"), F.col("x"), F.col("x").rlike(f"^(?:{glob_regex('src/**/*.{rs,py}')})$").cast("string"))
    marked = spark.createDataFrame([("//x",), ("// x",), ("//-x",)], "x string").select(F.lit("space"), F.col("x"), space_after_marker(F.col("x")))
    return ages.union(encoded).union(matched).union(marked)


_QUERIES = (classified_specimens, policy_grid, shaped_specimens, layout_specimens, mapped_offsets, verified_specimens, detected_paths, expired_specimens, scalar_specimens)
_NAMED = {f"lexer_{language}" + ("" if dialect == "standard" else f"_{dialect}"): (language, dialect, program) for language, dialect, program in PROGRAMS}
QUERIES = {f.__name__: f for f in _QUERIES} | {name: _lexer(*p) for name, p in _NAMED.items()}

ORACLE_SQL = {name: _lexer_sql(p[2]) for name, p in _NAMED.items()} | {
    "classified_specimens": _values("path, kinds", [(p, k) for p, _, _, k in CLASSIFIED]),
    "policy_grid": _GRID,
    "shaped_specimens": _values("path, explanations", [(n, e) for n, _, _, e in SHAPED]),
    "layout_specimens": _values("layout, source, output", LAID_OUT),
    "mapped_offsets": _values("path, offset, mapped", [("f", 0, 0), ("f", 1, 1), ("f", 3, 2), ("f", 10, 3), ("f", 11, 4)]).replace("(path, offset,", '(path, "offset",'),
    "verified_specimens": _values("path, problem", [("left", "comments left"), ("broken", "invalid output")]),
    "detected_paths": _values("path, language, dialect, detected_by", [(p, *rest) for p, _, *rest in DETECTED]),
    "expired_specimens": _values("line, tag, action, expired", [(1, "TODO", "remove", True), (2, "TODO", "keep", False), (3, "NOTE", "keep", False), (4, None, "remove", False)]),
    "scalar_specimens": _values('"function", argument, value', [("age", "14d", "14"), ("age", "2w", "14"), ("percent", "a b*~é", "a%20b%2A~%C3%A9"), ("percent", "x/y", "x/y"), ("glob", "src/a/b/c.py", "true"), ("glob", "a/b.py", "false"), ("glob", "src/x.rs", "true"), ("space", "//x", "// x"), ("space", "// x", "// x"), ("space", "//-x", "//-x")]),
}
