"""Source trees as tables: every file of a tree, what is skipped of it and why, and the language of the rest."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marginalia.functions.text import glob_regex
from marginalia.operators.detect import detect, generated, is_binary
from marginalia.session import ship

MAX_SIZE = 32 << 20
IGNORE_FILES = (".gitignore", ".ignore")


class Slice(InputPartition):
    def __init__(self, files):
        self.files = files


@functools.cache
def glob(pattern: str) -> re.Pattern:
    """A pattern of an ignore file: * and ? stay within a name, a ** that fills a part spans folders, [] are classes."""
    out, parts = "", pattern.split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        for cell in re.findall(r"\\.|\[!?\]?[^\]]*\]|.", part, re.S):
            if cell in ("*", "?"):
                out += "[^/]*" if cell == "*" else "[^/]"
            elif cell[0] == "[" and len(cell) > 1:
                out += f"(?!/)[{'^' if cell[1] in '!^' else ''}" + cell[1:-1].lstrip("!^").replace("\\", "\\\\").replace("[", "\\[") + "]"
            else:
                out += re.escape(cell[-1])
        out += "" if last else "/"
    return re.compile(out + r"\Z", re.S)


def ignored(patterns: list[tuple[str, str, bool]], path: str, folder: bool) -> bool:
    """Do the ignore patterns (folder, pattern, negated) in order exclude this path?"""
    out = False
    for base, pattern, negated in patterns:
        if base and not path.startswith(base + "/"):
            continue
        rest = path[len(base) + 1 :] if base else path
        only_folder = pattern.endswith("/")
        p = pattern[:-1] if only_folder else pattern
        if only_folder and not folder:
            continue
        hit = glob(p.removeprefix("/")).match(rest if "/" in p else os.path.basename(rest))
        if hit:
            out = not negated
    return out


class TreeReader(DataSourceReader):
    """Lists a local tree on the driver; the executors read the files. Hidden parts are left out, names that begin with _ are not."""

    def __init__(self, options):
        self.root = options.get("path", ".")
        self.hidden = options.get("hidden", "false") == "true"
        self.links = options.get("follow_symlinks", "false") == "true"
        self.parts = int(options.get("partitions", "64"))
        self.max_size = int(options.get("max_size", str(MAX_SIZE)))

    def listing(self) -> list[tuple[str, int, bool]]:
        found, rules = [], []
        for folder, names, files in os.walk(self.root, followlinks=self.links):
            base = os.path.relpath(folder, self.root).replace(os.sep, "/")
            base = "" if base == "." else base
            for name in IGNORE_FILES:
                if name in files:
                    with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as lines:
                        for line in lines:
                            p = line.rstrip("\n").strip()
                            if p and not p.startswith("#"):
                                rules.append((base, p.lstrip("!"), p.startswith("!")))
            where = lambda n, base=base: f"{base}/{n}" if base else n
            names[:] = sorted(n for n in names if n != ".git" and (self.hidden or not n.startswith(".")) and not ignored(rules, where(n), True))
            for n in sorted(files):
                if (self.hidden or not n.startswith(".")) and not ignored(rules, where(n), False):
                    full = os.path.join(folder, n)
                    found.append((where(n), os.lstat(full).st_size if os.path.islink(full) and not os.path.exists(full) else os.stat(full).st_size, os.path.islink(full)))
        return sorted(found)

    def partitions(self):
        files = self.listing()
        k = max(1, min(self.parts, len(files)))
        return [Slice(files[i::k]) for i in range(k)]

    def read(self, part) -> Iterator[tuple]:
        for path, size, link in part.files:
            content = None
            error = None
            if not (link and not self.links) and size <= self.max_size:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        content = f.read()
                except OSError as e:
                    error = e.strerror
            yield path, content, size, link, error


class Tree(DataSource):
    """spark.read.format("source_tree").load(path)"""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path string, content binary, size long, is_symlink boolean, error string"

    def reader(self, schema):
        return TreeReader(self.options)


def read_tree(spark: SparkSession, path: str, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(Tree)
    return spark.read.format("source_tree").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)


def standard_input(spark: SparkSession, content: bytes, language: str, dialect: str = "standard") -> DataFrame:
    """One unnamed buffer as a source."""
    return spark.createDataFrame([("<stdin>", bytearray(content), language, dialect)], "path string, content binary, language string, dialect string")


def route(
    files: DataFrame,
    include: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    include_generated: bool = False,
    follow_symlinks: bool = False,
    max_size: int = MAX_SIZE,
    disabled: tuple[str, ...] = (),
    profiles: dict[str, dict] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(sources, skipped) of a tree: a file that isn't read says why. A language unknown by name is a profile's if its name or extension is
    one of the profile's; of several the first by name."""
    any_glob = lambda globs: F.col("path").rlike("^(?:" + "|".join(glob_regex(g) for g in globs) + ")$")
    d = detect(files)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    profile = F.lit(None).cast("string")
    for key in sorted(profiles or {}, reverse=True):
        p = profiles[key]
        hit = name.isin(*p.get("filenames", [])) if p.get("filenames") else F.lit(False)
        hit = hit | ext.isin(*[e.lower() for e in p["extensions"]]) if p.get("extensions") else hit
        profile = F.when(hit, F.lit(f"profile:{key}")).otherwise(profile)
    d = d.withColumn("_p", profile)
    # a profile that claims the path is asked before the content's markup hint
    weak = F.col("language").isNull() | (F.col("detected_by") == "content")
    d = d.withColumn("language", F.when(weak & F.col("_p").isNotNull(), F.col("_p")).otherwise(F.col("language"))).withColumn("dialect", F.coalesce("dialect", F.lit("standard")))
    link = F.col("is_symlink") if "is_symlink" in files.columns else F.lit(False)
    failed = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    reason = (
        F.when(~any_glob(include), "not included") if include else F.when(F.lit(False), "")
    )
    if exclude:
        reason = reason.when(any_glob(exclude), "excluded")
    reason = reason.when(link & F.lit(not follow_symlinks), "symlink").when(failed, "error").when(F.col("size") > max_size, "too large").when(is_binary(F.col("content")), "binary")
    if not include_generated:
        reason = reason.when(generated(F.col("content"), F.col("path")), "generated")
    reason = reason.when(F.col("language").isNull(), "unknown language")
    if disabled:
        reason = reason.when(F.col("language").isin(*disabled), "disabled language")
    d = d.withColumn("reason", reason)
    skipped = d.where("reason IS NOT NULL").select("path", "reason", (F.col("reason") == "error").alias("error"))
    return d.where("reason IS NULL").select("path", "content", "size", "language", "dialect", "detected_by"), skipped
