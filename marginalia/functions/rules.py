"""What languages, markers and policies are called and how they read. They must equal the values that users' files rely on."""

#: language -> extensions
EXTENSIONS = {
    "rust": "rs",
    "ocaml": "ml mli mlt",
    "c": "c h m",
    "cpp": "cc cpp cxx hh hpp hxx mm cu cuh",
    "go": "go",
    "java": "java",
    "javascript": "js mjs cjs jsx",
    "typescript": "ts mts cts tsx",
    "python": "py pyw pyi",
    "shell": "sh bash zsh",
    "html": "html htm xhtml shtml",
    "css": "css scss sass",
    "jsonc": "jsonc json5 json",
    "sql": "sql",
    "kotlin": "kt kts",
    "toml": "toml",
    "lua": "lua rockspec",
    "yaml": "yml yaml",
    "php": "php phtml phpt",
    "ruby": "rb rbw rake gemspec ru podspec jbuilder thor rbi",
    "zig": "zig zon",
    "r": "r",
    "dart": "dart",
    "swift": "swift",
    "csharp": "cs csx",
    "scala": "scala sc",
    "markdown": "md markdown rmd",
    "perl": "pl pm t",
    "vue": "vue",
    "svelte": "svelte",
}
#: extension -> dialect, where it isn't standard
EXTENSION_DIALECTS = {"m": "objective-c", "mm": "objective-cpp", "cu": "cuda", "cuh": "cuda", "jsx": "jsx", "tsx": "tsx", "sh": "posix-sh", "bash": "bash53", "zsh": "zsh", "scss": "scss", "sass": "sass"}
#: lower-cased file name -> (language, dialect)
RESERVED_NAMES = {
    **dict.fromkeys("dockerfile containerfile .profile .bashrc .zshrc makefile gnumakefile".split(), ("shell", "posix-sh")),
    **dict.fromkeys("cargo.lock pipfile poetry.lock uv.lock pdm.lock".split(), ("toml", "standard")),
    **dict.fromkeys(".clang-format .clang-tidy .yamllint".split(), ("yaml", "standard")),
    **dict.fromkeys("gemfile rakefile guardfile capfile vagrantfile brewfile podfile fastfile appfile berksfile thorfile dangerfile .irbrc .pryrc".split(), ("ruby", "standard")),
    ".rprofile": ("r", "standard"),
}
#: interpreter -> (language, dialect); a version number may follow python and lua
INTERPRETERS = {
    "python": ("python", "standard"),
    "bash": ("shell", "bash53"),
    "zsh": ("shell", "zsh"),
    "luajit": ("lua", "standard"),
    "lua": ("lua", "standard"),
    "php": ("php", "standard"),
    "truffleruby": ("ruby", "standard"),
    "jruby": ("ruby", "standard"),
    "ruby": ("ruby", "standard"),
    "rscript": ("r", "standard"),
    "dart": ("dart", "standard"),
    "swift": ("swift", "standard"),
    "dotnet-script": ("csharp", "standard"),
    "perl": ("perl", "standard"),
    "scala-cli": ("scala", "standard"),
    "scala": ("scala", "standard"),
    "sh": ("shell", "posix-sh"),
    "node": ("javascript", "standard"),
    "deno": ("javascript", "standard"),
    "r": ("r", "standard"),
}
VERSIONED_INTERPRETERS = ("python", "lua")
#: language -> dialects beside standard
DIALECTS = {
    "c": "objective-c gnu-c",
    "cpp": "objective-cpp gnu-cpp cuda",
    "javascript": "jsx",
    "typescript": "tsx",
    "shell": "posix-sh bash53 zsh",
    "css": "scss sass",
    "sql": "postgresql mysql sqlite t-sql oracle",
}

GENERATED_NAMES = "Cargo.lock package-lock.json pnpm-lock.yaml yarn.lock bun.lock composer.lock Gemfile.lock poetry.lock uv.lock pdm.lock Pipfile.lock flake.lock go.sum go.work.sum deno.lock packages.lock.json".split()
GENERATED_EXTENSIONS = ["proptest-regressions"]
GENERATED_HEADERS = ["@generated", "do not edit", "do not modify", "automatically generated", "auto-generated", "autogenerated", "code generated by", "generated by ", "this file was generated", "this file is generated"]
GENERATED_HEADER_LINES = 5

LEGAL_MARKERS = ["spdx-license-identifier", "copyright", "licensed under", "permission is hereby granted", "all rights reserved", "@license", "@preserve"]

OPENERS = ["<!--", "///", "//!", "//", "/**", "/*", "(**", "(*", ";;", ";", "--", "%", "#"]
CLOSERS = ["-->", "*/", "*)"]

#: directives of every language: what the comment's text begins with
COMMON_DIRECTIVES = [
    "sourcemappingurl=", "sourceurl=", "#__pure__", "@__pure__", "__pure__", "#__no_side_effects__", "__no_side_effects__", "ts-ignore", "ts-expect-error", "ts-nocheck", "ts-check",
    "eslint", "prettier-ignore", "stylelint", "noinspection", "nolint", "noqa", "type: ignore", "fmt:", "rustfmt::", "clang-format", "spotless:", "ktlint-disable", "ktlint-enable",
    "detekt:", "istanbul ignore", "c8 ignore", "coverage:", "formatter:", "region", "endregion",
]
#: whole words that every language's comments may begin with
COMMON_KEYWORDS = ["shellcheck", "nosonar"]
SUPPRESSIONS = ["biome-ignore", "biome-ignore-all", "biome-ignore-start", "biome-ignore-end"]
#: language -> beginnings
DIRECTIVES = {
    "c": ["pragma", "line ", "cppcheck-suppress"],
    "cpp": ["pragma", "line ", "cppcheck-suppress"],
    "go": ["+build", "lint:ignore", "lint:file-ignore"],
    "python": ["pyright:", "mypy:", "ruff:", "pylint:", "pragma:"],
    "shell": ["syntax="],
    "toml": ["taplo:"],
    "lua": ["luacheck:", "selene:", "stylua:", "luacov:"],
    "yaml": ["yaml-language-server:", "renovate:", "checkov:skip", "trivy:ignore"],
    "ruby": ["frozen_string_literal:", "warn_indent:", "shareable_constant_value:", "rubocop:", "standard:", "typed:"],
    "php": ["phpcs:"],
    "r": ["styler:"],
    "dart": ["ignore:", "ignore_for_file:"],
    "swift": ["swift-tools-version:", "swiftlint:", "swiftformat:"],
    "java": ["$non-nls", "checkstyle:"],
}
#: language -> whole words
DIRECTIVE_KEYWORDS = {"shell": ["hadolint"], "toml": [":schema"], "yaml": ["yamllint", "nosec", "kics-scan"], "r": ["nocov"], "perl": ["no critic", "use critic"], "javascript": ["vite-ignore"], "typescript": ["vite-ignore"]}
#: language -> beginnings and words without which a build or a program differs
LOAD_BEARING = {
    "go": ["go:", "+build"],
    "swift": ["swift-tools-version:"],
    "ruby": ["frozen_string_literal:", "warn_indent:", "shareable_constant_value:"],
    "shell": ["syntax="],
    "dart": ["@dart"],
    "scala": ["//> using"],
    "typescript": ["///", "webpack", "vite-ignore", "#__pure__", "@__pure__", "__pure__", "#__no_side_effects__", "__no_side_effects__"],
    "javascript": ["webpack", "vite-ignore", "#__pure__", "@__pure__", "__pure__", "#__no_side_effects__", "__no_side_effects__"],
}

#: policy -> kinds it keeps
POLICY_KEEPS = {
    "none": ["line", "block", "doc-line", "doc-block", "license", "directive", "load-bearing", "html-comment", "shebang", "encoding", "optimizer-hint", "version-comment"],
    "conservative": ["doc-line", "doc-block", "license", "directive", "load-bearing", "html-comment", "shebang", "encoding", "optimizer-hint", "version-comment"],
    "standard": ["directive", "load-bearing", "html-comment", "shebang", "encoding", "optimizer-hint", "version-comment"],
    "all": ["load-bearing", "shebang", "encoding", "optimizer-hint", "version-comment"],
}
PROTECTION = {"shebang": "preamble", "encoding": "preamble", "load-bearing": "load-bearing", "optimizer-hint": "load-bearing", "version-comment": "load-bearing"}

#: diagnostic codes after which nothing of the file is certain; the others concern their span
DAMAGE_REST = ["lexical-ambiguity", "nesting-limit", "unknown-language"]
SHAPED_KINDS = ["line", "block"]
COMMENTARY_KINDS = ["line", "block", "html-comment"]
