"""What each language's lexer must find, and what it must not."""

import random

import pytest

from marginalia.operators.lexing import LEXERS, scan, scan_profile

CASES = [
    ("rust", "standard", 'let a = "// no"; /* a /* b */ c */ let r = r#"/* "no */"#; // yes', ["/* a /* b */ c */", "// yes"]),
    ("rust", "standard", "fn f<'a>(x: &'a str) { let c = '\"'; } /// doc", ["/// doc"]),
    ("c", "standard", 'char *s = "/* no */"; char c = \'"\'; /* yes */ // and \\\nthis', ["/* yes */", "// and \\\nthis"]),
    ("cpp", "standard", 'auto s = R"x(// )" no)x"; // yes', ["// yes"]),
    ("go", "standard", "s := `// no`; r := '\"' // yes", ["// yes"]),
    ("java", "standard", 'String s = """\n // no\n"""; /** doc */', ["/** doc */"]),
    ("javascript", "standard", "let r = /\\/\\/ no/g; let d = a / b; // yes\nlet t = `// no ${ f(/* in */ 1) } // no`", ["// yes", "/* in */"]),
    ("javascript", "standard", "#!/usr/bin/node\nx", ["#!/usr/bin/node"]),
    ("javascript", "jsx", "const a = <p title='x'>// text {/* yes */ 1}</p>; // end", ["/* yes */", "// end"]),
    ("python", "standard", "s = '# no'; t = '''\n# no\n'''; u = f\"{a # yes\n}\" # end", ["# yes", "# end"]),
    ("shell", "bash53", "echo a#b '# no' \"# no $(x # in\n)\" # yes\ncat <<EOF\n# no\nEOF\n# end", ["# in", "# yes", "# end"]),
    ("html", "standard", "<a title='<!-- no -->'><!-- yes --><script>// js\n</script><style>/* css */</style>", ["<!-- yes -->", "// js", "/* css */"]),
    ("css", "standard", "a { b: url(//no) } /* yes */ // no", ["/* yes */"]),
    ("css", "scss", "a { b: url(//no) } // yes\n$x: '#{/* in */ 1}';", ["// yes"]),
    ("jsonc", "standard", '{"a": "// no", /* yes */ "b": 1} // end', ["/* yes */", "// end"]),
    ("sql", "standard", "select '-- no', \"/* no */\" -- yes\n/* end */", ["-- yes", "/* end */"]),
    ("sql", "postgresql", "select $x$ -- no $x$, e'\\' -- no' /* a /* b */ c */", ["/* a /* b */ c */"]),
    ("sql", "mysql", "select 1--1 # yes\n-- end", ["# yes", "-- end"]),
    ("sql", "oracle", "select q'[ -- ' no ]' from d -- yes", ["-- yes"]),
    ("kotlin", "standard", 'val s = "// ${ f("}") /* in */ } no" /* a /* b */ */ // yes', ["/* in */", "/* a /* b */ */", "// yes"]),
    ("toml", "standard", "a = '# no' # yes\nb = \"\"\"\n# no\"\"\" # end", ["# yes", "# end"]),
    ("lua", "standard", "s = [==[ -- no ]==] --[[ yes\n]] x = '-- no' --- doc", ["--[[ yes\n]]", "--- doc"]),
    ("yaml", "standard", "a: 'x # no' # yes\nb: |\n  # no\nc: d#no\n# end", ["# yes", "# end"]),
    ("php", "standard", "// no <?php $a = '// no'; // yes ?> // no <?php # end\n#[Attr]", ["// yes ", "# end"]),
    ("ruby", "standard", "a = '# no'; b = \"#{c # in\n}\" # yes\n=begin\ntext\n=end\nd = %w(# no)\nputs <<~X # tail\n  # no\nX\n", ["# in", "# yes", "=begin\ntext\n=end", "# tail"]),
    ("zig", "standard", "const a = \"// no\";\nconst b =\n    \\\\// no\n; /// doc\n// yes", ["/// doc", "// yes"]),
    ("r", "standard", "a <- '# no'; b %# no% c; r\"(# no)\" # yes\n#' doc", ["# yes", "#' doc"]),
    ("dart", "standard", "var a = r'// no'; var b = '${ x /* in */ }'; /* a /* b */ */ /// doc", ["/* in */", "/* a /* b */ */", "/// doc"]),
    ("swift", "standard", 'let a = #"// no \\#( x /* in */ )"#; /* a /* b */ */ // yes', ["/* in */", "/* a /* b */ */", "// yes"]),
    ("csharp", "standard", 'var a = @"// no"""; var b = $"{x /* in */}"; var c = """ // no """; // yes', ["/* in */", "// yes"]),
    ("scala", "standard", 'val a = s"${ x /* in */ }"; val b = """// no"""; /* a /* b */ */ // yes', ["/* in */", "/* a /* b */ */", "// yes"]),
    ("ocaml", "standard", 'let a = "(* no *)" and c = \'"\' and q = {x|(* no|x} (* a (* b *) "*)" c *)', ['(* a (* b *) "*)" c *)']),
    ("markdown", "standard", "`<!-- no -->` <!-- yes -->\n\n```python\nx = 1 # in\n```\n\n    <!-- code -->\n", ["<!-- yes -->", "# in"]),
    ("perl", "standard", "my $a = q(# no); my $n = $#a; # yes\n=pod\n# no\n=cut\n# end", ["# yes", "# end"]),
    ("vue", "standard", "<template>{{ a /* in */ }}</template><script lang='ts'>// ts\n</script><!-- yes -->", ["/* in */", "// ts", "<!-- yes -->"]),
    ("svelte", "standard", "{a /* in */}<script>// js\n</script><!-- yes -->", ["/* in */", "// js", "<!-- yes -->"]),
]


@pytest.mark.parametrize("language,dialect,text,want", CASES)
def test_finds(language, dialect, text, want):
    comments, errors = scan(text.encode(), language, dialect)
    assert [text[a:b] for a, b, _ in comments] == want
    assert not errors


def test_kinds():
    kind = lambda text, language: [k for _, _, k in scan(text.encode(), language)[0]]
    assert kind("/// a\n//// b\n//! c\n/** d */\n/*** e */\n/**/\n/*! f */", "rust") == ["doc-line", "line", "doc-line", "doc-block", "block", "block", "doc-block"]
    assert kind("/// a\n/** b */\n/**/", "java") == ["doc-line", "doc-block", "block"]
    assert kind("<!-- a -->", "html") == ["html-comment"]
    assert kind("--- a\n---- b", "lua") == ["doc-line", "line"]


@pytest.mark.parametrize(
    "language,text,code",
    [("c", "/* open", "unterminated-comment"), ("c", 'x = "open\ny', "unterminated-string"), ("rust", "/* a /* b */", "unterminated-comment"), ("html", "<!-- open", "unterminated-comment"), ("python", "'''open", "unterminated-string"), ("shell", "cat <<X\nopen", "unterminated-heredoc"), ("nonsense", "x", "unknown-language"), ("perl", "$a[0] / 2", "lexical-ambiguity")],
)
def test_errors(language, text, code):
    assert [c for c, _, _ in scan(text.encode(), language)[1]] == [code]


def test_any_bytes_give_sorted_disjoint_spans():
    rng = random.Random(0)
    bits = ["/*", "*/", "//", "#", '"', "'", "`", "${", "}", "{", "\\", "\n", "\r\n", "<!--", "-->", "<script>", "</script>", "(*", "*)", "--", "[[", "]]", "<<X\nX\n", "x", " ", "\xff", "=begin\n", "<?php ", "?>", "|\n  ", "r#\"", "$x$", "%w(", ")", "q'["]
    for language in LEXERS:
        for _ in range(60):
            content = "".join(rng.choices(bits, k=rng.randint(0, 40))).encode("latin-1")
            comments, errors = scan(content, language)
            assert all(0 <= a < b <= len(content) for a, b, _ in comments), (language, content)
            assert all(x[1] <= y[0] for x, y in zip(comments, comments[1:], strict=False)), (language, content, comments)
            assert all(0 <= a <= b <= len(content) for _, a, b in errors), (language, content)


def test_profiles():
    dune = {"name": "dune", "line_comments": [{"start": ";"}], "block_comments": [{"start": "#|", "end": "|#", "nested": True}], "strings": [{"start": '"', "end": '"', "escape": "\\"}]}
    text = '(a "; no") ; yes\n#| a #| b |# c |#'
    assert [text[a:b] for a, b, _ in scan_profile(text.encode(), dune)[0]] == ["; yes", "#| a #| b |# c |#"]
    haskell = {"name": "h", "doc_continuation": True, "line_comments": [{"start": "-- |", "kind": "doc-line"}, {"start": "--", "forbidden_after": "!#$>", "kind": "line"}]}
    found = scan_profile(b"-- | doc\n-- more\n\n-- plain\nx --> y", haskell)[0]
    assert [k for _, _, k in found] == ["doc-line", "doc-line", "line"]
    with pytest.raises(ValueError):
        scan_profile(b"", {"name": "x"})


def test_type_parameters_in_tsx():
    for source in (b"const f = <T,>(x: T) => x // yes", b"const f = <T extends U>(x: T) => x // yes", b"const f = <const T, U>(x: T) => <b>// no</b> // yes", b"const f = <T = any,>(x: T) => x // yes"):
        comments, errors = scan(source, "typescript", "tsx")
        assert [source[a:b] for a, b, _ in comments] == [b"// yes"] and not errors, source
    comments, errors = scan(b"const x = <T extends=\"a\">// no</T> // yes", "typescript", "tsx")
    assert len(comments) == 1 and not errors


def test_markup_in_scala():
    for source in (b"val x = <a>// not</a> // yes", b"val x = <a b=\"// no\"/> // yes", b"val x = <a><!-- // no -->{f(1)}<b/>{{ // no</a> // yes", b"val y = a < b // yes", b"def f[A <: B](x: A) = x <= y // yes"):
        comments, errors = scan(source, "scala")
        assert [source[a:b] for a, b, _ in comments] == [b"// yes"] and not errors, source
    inner = b"val x = <a>{ f(1) /* in */ }</a>"
    assert [inner[a:b] for a, b, _ in scan(inner, "scala")[0]] == [b"/* in */"]
    assert scan(b"val x = <a>// open", "scala")[1]
