"""Which language a file is in, and why: its extension, else its name, else its first line, else its content."""

from __future__ import annotations

import shlex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import rules
from marginalia.functions.text import latin


def _lookup(pairs: dict[str, tuple[str, str]]) -> Column:
    """A map literal from a key to (language, dialect)."""
    cells = []
    for key, (language, dialect) in sorted(pairs.items()):
        cells += [F.lit(key), F.struct(F.lit(language).alias("language"), F.lit(dialect).alias("dialect"))]
    return F.create_map(*cells)


def extensions() -> dict[str, tuple[str, str]]:
    return {e: (language, rules.EXTENSION_DIALECTS.get(e, "standard")) for language, known in rules.EXTENSIONS.items() for e in known.split()}


def interpreter(line: str | None) -> str | None:
    """The program that a #! line runs, without its folder; env with options, assignments and -S is seen through."""
    if not line or not line.startswith("#!"):
        return None
    words = line[2:].split()
    if not words:
        return None
    name = words[0].rsplit("/", 1)[-1]
    if name != "env":
        return name.lower() or None
    rest = words[1:]
    while rest:
        w = rest.pop(0)
        if w in ("-S", "--split-string") or w.startswith(("-S", "--split-string=")):
            text = " ".join(([w.split("=", 1)[1]] if w.startswith("--split-string=") else [w[2:]] if w.startswith("-S") and len(w) > 2 else []) + rest)
            try:
                rest = shlex.split(text)
            except ValueError:
                return None
        elif w in ("-u", "-C", "--unset", "--chdir"):
            rest = rest[1:]
        elif w == "--" or w.startswith("-"):
            continue
        elif "=" in w and w.split("=", 1)[0].isidentifier():
            continue
        else:
            return w.rsplit("/", 1)[-1].lower() or None
    return None


def by_interpreter(program: Column) -> Column:
    """(language, dialect) of a program's name, with a version number where that is usual."""
    versions = "|".join(rules.VERSIONED_INTERPRETERS)
    plain = F.regexp_replace(program, f"^({versions})[0-9][0-9.]*$", "$1")
    return F.element_at(_lookup(rules.INTERPRETERS), plain)


def detect(files: DataFrame) -> DataFrame:
    """Adds language, dialect and detected_by (extension, reserved-filename, shebang, content; null where nothing tells) to path, content."""
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    ext = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    first = F.substring_index(latin(F.col("content")), "\n", 1)
    program = F.udf(interpreter, "string")(F.when(first.startswith("#!"), first))
    head = F.lower(latin(F.substring("content", 1, 4096)))
    markup = head.contains("<!doctype html") | head.contains("<html")
    found = files.withColumn("_e", F.element_at(_lookup(extensions()), ext)).withColumn("_n", F.element_at(_lookup(rules.RESERVED_NAMES), name))
    # the program's name is asked of Python only where the path doesn't tell
    asked = F.col("_e").isNull() & F.col("_n").isNull() & first.startswith("#!")
    found = found.withColumn("_s", F.when(asked, by_interpreter(program)))
    content = F.when(markup, F.struct(F.lit("html").alias("language"), F.lit("standard").alias("dialect")))
    best = F.coalesce("_e", "_n", "_s", content)
    how = F.when(F.col("_e").isNotNull(), "extension").when(F.col("_n").isNotNull(), "reserved-filename").when(F.col("_s").isNotNull(), "shebang").when(markup, "content")
    return found.withColumn("_b", best).withColumn("detected_by", how).withColumn("language", F.col("_b.language")).withColumn("dialect", F.col("_b.dialect")).drop("_e", "_n", "_s", "_b")


def generated(content: Column, path: Column) -> Column:
    """Is the file made by a tool: by its name, its extension, or a phrase in its first lines?"""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    head = F.lower(F.substring_index(latin(content), "\n", rules.GENERATED_HEADER_LINES))
    by_name = name.isin(*rules.GENERATED_NAMES) | F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*rules.GENERATED_EXTENSIONS)
    return by_name | F.exists(F.array(*map(F.lit, rules.GENERATED_HEADERS)), lambda p: head.contains(p))


def is_binary(content: Column) -> Column:
    """Is there a NUL in the first 8192 bytes?"""
    return F.instr(latin(F.substring(content, 1, 8192)), "\x00") > 0


def languages(spark) -> DataFrame:
    """The catalogue: one row for each language."""
    rows = [(n, sorted(e.split()), ["standard", *rules.DIALECTS.get(n, "").split()], sorted(k for k, v in rules.RESERVED_NAMES.items() if v[0] == n), sorted(k for k, v in rules.INTERPRETERS.items() if v[0] == n)) for n, e in rules.EXTENSIONS.items()]
    return spark.createDataFrame(rows, "language string, extensions array<string>, dialects array<string>, reserved_names array<string>, interpreters array<string>")


def check_dialect(language: str, dialect: str) -> None:
    if dialect != "standard" and dialect not in rules.DIALECTS.get(language, "").split():
        raise ValueError(f"{language} has no dialect {dialect}")
