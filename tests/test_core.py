"""Classification, verdicts, shape rules, layouts, maps, aggregates, sources and live documents."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia import queries
from marginalia.functions import rules
from marginalia.functions.text import age_days, column_of, comment_text, extension_label, glob_regex, latin, line_of, opening_tag, percent_encode
from marginalia.operators import lex
from marginalia.operators.classify import classify
from marginalia.operators.detect import detect, interpreter
from marginalia.operators.layout import applied, plan, plan_edits, source_map, through
from marginalia.operators.shape import expire
from marginalia.operators.style import reflow, sentences, space_after_marker, trailing_whitespace
from marginalia.operators.verdict import Options, decide
from marginalia.plans import analyse, reports
from marginalia.schema import KINDS, POLICIES
from marginalia.session import SLICE_BYTES, slices
from marginalia.sources.files import read_tree, route
from marginalia.streaming.documents import EDITS, follow, live, to_bytes


def sources(spark, *rows):
    """rows: (path, text, language)"""
    return spark.createDataFrame([(p, bytearray(t.encode()), g, "standard") for p, t, g in rows], "path string, content binary, language string, dialect string")


def judged(spark, text, language, **options):
    rows = analyse.judge(sources(spark, ("f", text, language)), Options(**options)).orderBy("span_start").collect()
    return [(r["raw"], r["kind"], r["action"], r["explanation"]) for r in rows]


def test_policy_grid(spark):
    df = spark.createDataFrame([(k, "x") for k in KINDS], "kind string, raw string")
    for policy in POLICIES:
        for force in (False, True):
            got = {r["kind"]: r["action"] for r in decide(df, Options(policy=policy, force_protected=force)).collect()}
            for k in KINDS:
                keeps = k in rules.POLICY_KEEPS[policy] and not (force and policy != "none" and k in rules.PROTECTION)
                keeps = keeps or (k in rules.PROTECTION and not force)
                assert got[k] == ("keep" if keeps else "remove"), (policy, force, k)


def test_named_kinds_and_patterns(spark):
    text = "// TODO a\n// plain\n// secret"
    assert [a for _, _, a, _ in judged(spark, text, "c", keep_regex=("TODO",), policy="all")] == ["keep", "keep", "keep"]  # one block
    assert [a for _, _, a, _ in judged(spark, text, "c", keep_kinds=("line",), policy="all")] == ["keep"] * 3
    assert [e for *_, e in judged(spark, "// a\n\n// b", "c", remove_regex=("b",), policy="none")] == ["kept-by-policy", "removed-by-regex"]
    assert judged(spark, "// a keep-me", "c", protected=(("keep-me", "ours", "load-bearing"),))[0][1:3] == ("load-bearing", "keep")
    with pytest.raises(ValueError):
        Options(keep_regex=("(?=x)",))


def test_classification(spark):
    cases = [
        ("#!/bin/sh\n# coding: x", "shell", ["shebang", "line"]),
        ("#!/usr/bin/python\n# -*- coding: utf-8 -*-\n# coding: late", "python", ["shebang", "encoding", "line"]),
        ("/*+ hint */ /*! version */ -- plain", "sql", ["optimizer-hint", "version-comment", "line"]),
        ("// Copyright 2020 x\n// SPDX-License-Identifier: MIT\n/* @preserve */", "c", ["license"] * 3),
        ("//go:build linux\n// +build x\n// go:build prose\n//nolint", "go", ["load-bearing", "load-bearing", "line", "directive"]),
        ("import(/* webpackChunkName: 'x' */ y) // webpackish prose\n/* @vite-ignore */ /*#__PURE__*/ // eslint-disable-line", "javascript", ["load-bearing", "line", "load-bearing", "load-bearing", "directive"]),
        ('/// <reference path="x" />\n// @ts-ignore', "typescript", ["load-bearing", "directive"]),
        ("# pylint: disable\n# noqa\n# pylint\n# shellcheck disable=x\n# shellchecker", "python", ["directive", "directive", "line", "directive", "line"]),
        ("# frozen_string_literal: true\n# rubocop:disable X", "ruby", ["load-bearing", "directive"]),
        ("# syntax=docker/x\n# hadolint ignore=y\n#MISE depends=z\n# mise prose", "shell", ["load-bearing", "directive", "load-bearing", "line"]),
        ("// zig fmt: off\n// zig fmt: off please", "zig", ["directive", "line"]),
        ("// swift-tools-version:5.3\n// swift-format-ignore\n// swift-format-ignored", "swift", ["load-bearing", "directive", "line"]),
        ("//> using dep x\n//> usingless", "scala", ["load-bearing", "line"]),
        ("- uses: a/b@" + "0" * 40 + " # v1.2\n- uses: a/b@v1 # v1.2", "yaml", ["directive", "line"]),
        ("/* biome-ignore lint: x */ // biome-ignored", "javascript", ["directive", "line"]),
    ]
    df = sources(spark, *[(str(i), t, g) for i, (t, g, _) in enumerate(cases)])
    from marginalia.operators import lex

    got = {}
    for r in classify(lex.comments(lex.reports(df))).orderBy("path", "span_start").collect():
        got.setdefault(int(r["path"]), []).append(r["kind"])
    for i, (text, _, want) in enumerate(cases):
        assert got[i] == want, text


def test_shape_rules(spark):
    text = "int a; // trailing\n// NOTE: kept\n// NOTEBOOK\n\n// one\n// two\n// three\n"
    base = judged(spark, text, "c", policy="standard", tags=("note",))
    assert [a for _, _, a, _ in base] == ["remove", "keep", "remove", "remove", "remove", "remove"]
    doc = "int a; // t\n\n// one\n// two\n// three\n\n// x"
    kept = dict(policy="conservative", remove_kinds=(), keep_kinds=())
    assert {e for *_, e in judged(spark, doc, "c", **kept)} == {"removed-by-policy"}
    long = judged(spark, doc, "c", policy="standard", tags=("one", "two", "three", "t", "x"), max_lines=2, trailing=False)
    assert [e for *_, e in long] == ["trailing", "too-long", "too-long", "too-long", "tagged"]
    assert [a for _, _, a, _ in judged(spark, doc, "c", policy="none", tags=("one",), trailing=False, max_lines=1)] == ["keep"] * 5


def test_expiry(spark):
    options = Options(policy="standard", expiry={"TODO": "10d", "NOTE": 5})
    j = analyse.judge(sources(spark, ("f", "// TODO old\n// TODO new\n// NOTE undated\n// plain", "c")), options)
    blame = spark.createDataFrame([("f", 1, "2025-01-01 00:00:00"), ("f", 2, "2025-01-20 00:00:00"), ("f", 3, None)], "path string, line long, commit_ts string")
    rows = expire(j, blame.withColumn("commit_ts", F.to_timestamp("commit_ts")), options, "2025-01-25 00:00:00").orderBy("span_start").collect()
    assert [(r["action"], r["expired"]) for r in rows] == [("remove", True), ("keep", False), ("keep", False), ("remove", False)]
    assert [tuple(r) for r in analyse.overdue(expire(j, blame.withColumn("commit_ts", F.to_timestamp("commit_ts")), options, "2025-01-25 00:00:00")).collect()] == [("TODO", 1)]


@pytest.mark.parametrize(
    "layout,text,want",
    [
        ("lines", "a/* x */b", "a b"),
        ("lines", "a /* x\ny */ b", "a \n b"),
        ("lines", "// x\na\n", "\na\n"),
        ("columns", "a /* x */ b", "a         b"),
        ("columns", "a /* \t*/b", "a            b"[: len("a ") + 8] + "b"),
        ("compact", "a\n// x\nb\n", "a\nb\n"),
        ("compact", "a // x\nb\n", "a\nb\n"),
        ("compact", "a /* x */ b", "a b"),
        ("compact", "a/* x */b", "a b"),
        ("compact", "a\n\n// x\n\nb\n", "a\n\nb\n"),
        ("compact", "  // x\n  // y\nb", "b"),
    ],
)
def test_layouts(layout, text, want):
    from marginalia.operators.lexing import scan

    edits = plan(text, [(a, b, k) for a, b, k in scan(text.encode(), "c")[0]], layout)
    out, at = "", 0
    for a, b, new in edits:
        assert a >= at
        out, at = out + text[at:a] + new, b
    if "\t" not in text:
        assert out + text[at:] == want
    else:
        assert (out + text[at:]).endswith("b")


def test_transform_map_and_verify(spark):
    rng = random.Random(1)
    bits = ["/* é */", "// x\n", "a", " ", "\n", '"// s"', "\r\n", "日"]
    df = sources(spark, *[(str(i), "".join(rng.choices(bits, k=rng.randint(0, 25))), "c") for i in range(40)], ("bad", "a /* open", "c"))
    options = Options(policy="all")
    for layout in ("lines", "columns", "compact"):
        plans = plan_edits(analyse.judge(df, options), df, layout)
        done = applied(plans)
        out = {r["path"]: (bytes(r["content"]), bytes(r["output"])) for r in done.collect()}
        assert out["bad"][0] == out["bad"][1]
        assert analyse.verify(done, df, options).count() == 0
        segments = source_map(plans)
        for path in out:
            own = sorted(map(tuple, segments.where(F.col("path") == path).select("original_start", "original_end", "output_start", "output_end", "exact").collect())) if path in ("0", "1", "2") else []
            content, output = out[path]
            for a, b, c, d, exact in own:
                assert not exact or content[a:b] == output[c:d]
            if own:
                assert sum(x[1] - x[0] for x in own) == len(content) and sum(x[3] - x[2] for x in own) == len(output)
        if layout == "lines":
            assert all(a.count(b"\n") == b.count(b"\n") for a, b in out.values())
    one = sources(spark, ("f", "a /* x */ b", "c"))
    segments = source_map(plan_edits(analyse.judge(one, options), one, "lines"))
    offsets = spark.createDataFrame([("f", o) for o in (0, 3, 10, 11)], "path string, offset long")
    assert {r["offset"]: r["mapped"] for r in through(offsets, segments).collect()} == {0: 0, 3: 2, 10: 3, 11: 4}


def test_scalars(spark):
    df = spark.createDataFrame([(bytearray(b"ab\r\ncd\ref\n"),)], "content binary").select(latin(F.col("content")).alias("s"))
    got = [df.select(line_of(F.col("s"), F.lit(i)).alias("l"), column_of(F.col("s"), F.lit(i)).alias("c")).first() for i in (0, 1, 4, 7)]
    assert [tuple(r) for r in got] == [(1, 1), (1, 2), (2, 1), (3, 1)]
    tags = spark.createDataFrame([("TODO: x",), (" * FIXME(a)",), ("NOTEs",), ("Todo",), ("A",), ("X1_Y",)], "t string")
    assert [r[0] for r in tags.select(opening_tag(F.col("t"))).collect()] == ["TODO", "FIXME", None, None, None, "X1_Y"]
    names = spark.createDataFrame([("a/b.py",), ("Makefile",), (".bashrc",), ("",), ("a b*~é",)], "p string")
    assert [r[0] for r in names.select(extension_label(F.col("p"))).collect()] == [".py", "Makefile", ".bashrc", "<unnamed>", "a b*~é"]
    assert names.select(percent_encode(F.col("p"))).collect()[4][0] == "a%20b%2A~%C3%A9"
    assert (age_days("14d"), age_days("2w"), age_days(3)) == (14, 14, 3)
    import re

    assert re.fullmatch(glob_regex("src/**/*.{rs,py}"), "src/a/b/c.py") and not re.fullmatch(glob_regex("*.py"), "a/b.py")


def test_detection(spark):
    rows = [("a.PY", b""), ("Dockerfile", b""), ("x/run", b"#!/usr/bin/env -S python3.11 -u\n"), ("run2", b"#!/bin/bash -e\n"), ("page", b"<!DOCTYPE html>"), ("none", b"text"), ("b.tsx", b"")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r["path"]: (r["language"], r["dialect"], r["detected_by"]) for r in detect(df).collect()}
    assert got == {
        "a.PY": ("python", "standard", "extension"),
        "Dockerfile": ("shell", "posix-sh", "reserved-filename"),
        "x/run": ("python", "standard", "shebang"),
        "run2": ("shell", "bash53", "shebang"),
        "page": ("html", "standard", "content"),
        "none": (None, None, None),
        "b.tsx": ("typescript", "tsx", "extension"),
    }
    assert interpreter("#!/usr/bin/env A=1 -i node x") == "node" and interpreter("#!") is None and interpreter("x") is None


def test_tree_source(spark, tmp_path):
    for name, content in {"a.py": b"# x", "_b.py": b"# y", ".hidden.py": b"# z", "bin.c": b"\x00", "gen.go": b"// Code generated by x. DO NOT EDIT.", "Cargo.lock": b"#", "skip/c.py": b"#", ".gitignore": b"skip/\n", "big.py": b"#" * 100, "x.unknown": b"x", "my.prof": b"; c"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    found, skipped = route(read_tree(spark, str(tmp_path)), exclude=("*.exc",), max_size=50, profiles={"p": {"name": "p", "extensions": ["prof"], "line_comments": [{"start": ";"}]}})
    assert {(r["path"], r["language"]) for r in found.collect()} == {("a.py", "python"), ("_b.py", "python"), ("my.prof", "profile:p")}
    assert {(r["path"], r["reason"]) for r in skipped.collect()} == {("bin.c", "binary"), ("gen.go", "generated"), ("Cargo.lock", "generated"), ("big.py", "too large"), ("x.unknown", "unknown language"), ("link.py", "symlink")}


def test_aggregates(spark, tmp_path):
    df = sources(spark, ("a.c", "// TODO one\n// two", "c"), ("b.py", "# one\n", "python"), ("c.c", "int x;", "c"))
    j = analyse.judge(df, Options(policy="standard"))
    skipped = spark.createDataFrame([("z.bin", "binary", False), ("e", "error", True)], "path string, reason string, error boolean")
    s = analyse.summary(j, df, skipped).first().asDict()
    assert (s["files"], s["files_with_findings"], s["removable"], s["skipped"], s["io_errors"]) == (3, 2, 3, 1, 1)
    assert reports.exit_code(analyse.summary(j, df)).first()[0] == 1
    assert [tuple(r) for r in analyse.busiest(j).collect()] == [("a.c", 2), ("b.py", 1)]
    c = analyse.coverage(df, skipped)
    assert analyse.coverage_share(c).first().asDict() == {"scanned": 3, "files": 5, "tenths_percent": 600}
    assert [tuple(r) for r in analyse.tag_inventory(j).collect()] == [("TODO", 1)]
    counts = analyse.ledger(j)
    reports.write_ledger(counts, str(tmp_path / "ledger"))
    recorded = reports.read_ledger(spark, str(tmp_path / "ledger"))
    assert analyse.drift(recorded, counts).count() == 0
    other = spark.createDataFrame([("a.c", 1), ("b.py", 3), ("gone", 2)], "path string, allowed long")
    assert {(r["path"], r["state"]) for r in analyse.drift(other, counts).collect()} == {("a.c", "grew"), ("b.py", "shrank"), ("gone", "absent")}
    unused = analyse.unused_settings(j, Options(keep_regex=("TODO", "zzz"), remove_regex=("qqq",), keep_kinds=("license", "line")))
    assert {tuple(r) for r in unused.collect()} == {("keep_regex", "zzz"), ("remove_regex", "qqq"), ("keep_kind", "license")}


def test_advice_looks_past_any_blanks(spark):
    text = "int a;\n// one\n" + " \n" * 300 + "struct b;\n// two\nint c;"
    j = analyse.judge(sources(spark, ("f", text, "c")), Options(policy="all"))
    assert {tuple(r) for r in analyse.advice(j).collect()} == {("document-item", 1, 1), ("among-statements", 1, 1)}


def test_style(spark):
    df = spark.createDataFrame([("//x",), ("// x",), ("//-x",), ("#x  \n#y\t\r\n",)], "raw string")
    assert [r[0] for r in df.select(space_after_marker(F.col("raw"))).collect()] == ["// x", "// x", "//-x", "# x  \n#y\t\r\n"]
    assert df.select(trailing_whitespace(F.col("raw"))).collect()[3][0] == "#x\n#y\r\n"
    assert sentences("One e.g. this. Two! `a. b` Three?") == ["One e.g. this.", "Two!", "`a. b` Three?"]
    assert reflow(["One. Two", "three.", "", "# Head", "- item one. item", "  two."], "sentence") == ["One.", "Two three.", "", "# Head", "- item one.", "  item two."]
    assert reflow(["a", "b"], "unwrap") == ["a b"] and reflow(["a", "b"], "preserve") == ["a", "b"]


def test_live_documents(spark, tmp_path):
    state, events = follow(None, [(1, "c", [(None, None, b"// a")]), (1, None, [(0, 0, b"x")]), (2, None, [(0, 99, b"")]), (3, None, [(4, 4, b"\n/* b */")])])
    assert [(e["accepted"], e["problem"], e["comments"]) for e in events] == [(True, None, 1), (False, "stale version", None), (False, "span out of bounds", None), (True, None, 2)]
    assert state[0] == b"// a\n/* b */"
    rows = [("u", 1, 0, None, None, bytearray(b"// a"), "c"), ("u", 2, 0, 4, 4, bytearray(b"\n// b"), None), ("v", 5, 0, None, None, bytearray(b"x"), "c"), ("u", 2, 0, 0, 0, bytearray(b"zz"), None)]
    spark.createDataFrame(rows, EDITS).write.parquet(str(tmp_path / "in"))
    stream = live(spark.readStream.schema(EDITS).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("live_events").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["uri"], r["version"]): (r["accepted"], r["comments"]) for r in spark.table("live_events").collect()}
    assert got[("u", 1)] == (True, 1) and got[("v", 5)] == (True, 0) and ("u", 2) in got
    assert to_bytes("aé\r\n😀b".encode(), 1, 2) == 9 and to_bytes(b"ab", 0, 1, "utf-8") == 1


def test_reports(spark):
    import json

    df = sources(spark, ("d i/a.c", "int x; // remove me\n", "c"))
    j = analyse.judge(df, Options(policy="standard"))
    assert json.loads(reports.jsonl(j).first()["value"])["comments"][0]["column"] == 8
    result = json.loads(reports.sarif_results(j).first()["value"])
    assert result["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "d%20i/a.c"
    assert reports.annotations(j).first()["value"] == "::notice file=d i/a.c,line=1,col=8::removable line: // remove me"
    assert b"-int x; // remove me" in bytes(reports.diffs(analyse.transform(df, Options(policy="standard"))).first()["diff"])
    assert "a.c:1:8: remove line" in reports.human(j).first()["text"]


def test_ignore_patterns():
    from marginalia.sources.files import ignored

    hit = lambda pattern, path, folder=False: ignored([("", pattern, False)], path, folder)
    assert hit("a/*.py", "a/b.py") and not hit("a/*.py", "a/b/c.py")
    assert hit("a/**/c.py", "a/c.py") and hit("a/**/c.py", "a/x/y/c.py") and hit("**/c.py", "x/c.py") and hit("a/**", "a/x/y")
    assert hit("*.py", "a/b/c.py") and hit("/c.py", "c.py") and not hit("/c.py", "a/c.py")
    assert hit("[!a]x", "bx") and not hit("[!a]x", "ax") and hit("build/", "build", True) and not hit("build/", "build")
    assert hit("a\\*", "a*") and not hit("a\\*", "ab")


def test_own_prefixes_and_whole_heads(spark):
    from marginalia.operators import detect
    from marginalia.operators.classify import classify

    rows = [("a", "python", "# mytool: keep", 0, "# mytool: keep", "line"), ("a", "python", "# other", 0, "# other", "line")]
    df = spark.createDataFrame(rows, "path string, language string, source string, span_start long, raw string, lexical_kind string")
    assert sorted(r["kind"] for r in classify(df, ("mytool:",)).collect()) == ["directive", "line"]
    head = "x" * 9000 + "\n" + "// " + "y" * 600 + " @generated\n"
    files = spark.createDataFrame([("a.c", bytearray(head.encode())), ("b.c", bytearray(b"plain")), ("c." + detect.rules.GENERATED_EXTENSIONS[0].upper(), bytearray(b"x"))], "path string, content binary")
    assert {r["path"]: r["g"] for r in files.select("path", detect.generated(files.content, files.path).alias("g")).collect()} == {"a.c": "@generated" in detect.rules.GENERATED_HEADERS, "b.c": False, "c." + detect.rules.GENERATED_EXTENSIONS[0].upper(): True}


@pytest.mark.parametrize("name", ["license_lines", "unused_settings", "ratchet_drift"])
def test_a_filter_on_kinds_leaves_their_text_computed_once(spark, name):
    """The optimizer must not put a comment's lower-case text into what refers to it: it did, dozens of times for each line."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_comment_text_takes_off_the_longest_marks(spark):
    marks = [*rules.OPENERS, *rules.CLOSERS, "", "/", "-", "*", "x", " ", "é", "\n"]
    raws = [a + b + c for a in marks for b in ("", "x é", "*") for c in marks]
    opener = re.compile("^(?:" + "|".join(re.escape(v) for v in sorted(rules.OPENERS, key=lambda v: -len(v))) + ")")
    closer = re.compile("(?:" + "|".join(map(re.escape, rules.CLOSERS)) + r")\Z")
    got = spark.createDataFrame([(x,) for x in raws], "raw string").select(comment_text(F.col("raw"))).collect()
    assert [r[0] for r in got] == [closer.sub("", opener.sub("", x)) for x in raws]


def test_batches_go_to_python_objects_in_small_parts():
    """All rows in order, in parts bounded by bytes and not by rows; null rows, slices and a row beyond the bound are no exception."""
    size = SLICE_BYTES // 4
    blobs = [b"x" * size] * 9 + [None, b""] + [b"y" * (3 * SLICE_BYTES)] + [b"z"] * 5
    lists = [None if b is None else ["a" * (len(b) // 2), "b", None] for b in blobs]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(blobs))), "content": pa.array(blobs, pa.binary()), "lines": pa.array(lists, pa.list_(pa.string()))}).slice(1)
    for named in (("content",), ("lines",), ("content", "lines")):
        parts = list(slices(iter([batch, batch.slice(0, 0), batch]), *named))
        assert [x for p in parts for x in p.column(0).to_pylist()] == 2 * list(range(1, len(blobs)))
        assert all(p.num_rows == 1 or sum(len(b or b"") for b in p.column(1).to_pylist()) * (1 if "content" in named else 0.5) <= SLICE_BYTES for p in parts)
        assert len(parts) > 2


def test_reports_send_parts_of_a_batch_and_no_content_unless_asked(spark):
    src = sources(spark, *((str(i), "int a; // " + "x" * 600_000, "c") for i in range(4))).coalesce(1)
    assert "content" not in lex.reports(src, content=False).columns
    assert {(r["path"], len(r["comments"])) for r in lex.reports(src, content=False).collect()} == {(str(i), 1) for i in range(4)}
