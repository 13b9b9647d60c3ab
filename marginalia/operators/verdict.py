"""Keep, remove or rewrite: a policy's verdict over each comment, and why. One CASE chain."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import rules
from marginalia.functions.text import age_days, fence
from marginalia.schema import KINDS, POLICIES


@dataclass(frozen=True)
class Options:
    policy: str = "conservative"
    force_protected: bool = False
    force_invalid: bool = False
    keep_kinds: tuple[str, ...] = ()
    remove_kinds: tuple[str, ...] = ()
    keep_regex: tuple[str, ...] = ()
    remove_regex: tuple[str, ...] = ()
    #: (substring, reason, tool or load-bearing)
    protected: tuple[tuple[str, str, str], ...] = ()
    #: beginnings of comments that are directives of the caller's own tools
    own_prefixes: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    max_lines: int | None = None
    trailing: bool | None = None
    #: tag -> age in days, or text such as 14d
    expiry: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise ValueError(f"no policy {self.policy}")
        for k in (*self.keep_kinds, *self.remove_kinds):
            if k not in KINDS:
                raise ValueError(f"no kind {k}")
        for p in (*self.keep_regex, *self.remove_regex):
            if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", p):
                raise ValueError(f"no look-around and no back-reference in {p!r}")

    @property
    def every_tag(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.tags, *self.expiry]))

    @property
    def limits(self) -> dict[str, int]:
        return {t: age_days(a) for t, a in self.expiry.items()}


def policy_keeps(policy: str, kind: Column) -> Column:
    return kind.isin(*rules.POLICY_KEEPS[policy])


def strongest_keeping(kinds: DataFrame) -> str:
    """The strongest policy beside `none` that keeps all of these kinds, or none. kinds: a column kind; one row comes back."""
    row = kinds.agg(*[F.coalesce(F.bool_and(policy_keeps(p, F.col("kind"))), F.lit(True)).alias(p) for p in POLICIES]).first()
    return next((p for p in reversed(POLICIES) if p != "none" and row[p]), "none")


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """The index of the first pattern that the text matches, or null."""
    if not patterns:
        return F.lit(None).cast("int")
    hit = F.array_position(F.array(*[text.rlike(p) for p in patterns]), True)
    return F.when(hit > 0, (hit - 1).cast("int"))


def protection(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, p in rules.PROTECTION.items():
        out = F.when(kind == k, F.lit(p)).otherwise(out)
    return out


def named_outright(kind: Column, raw: Column, options: Options) -> Column:
    """Do a kind list or a pattern name this comment itself?"""
    out = kind.isin(*options.keep_kinds) if options.keep_kinds else F.lit(False)
    return out | first_match(raw, options.keep_regex).isNotNull() if options.keep_regex else out


def decide(comments: DataFrame, options: Options) -> DataFrame:
    """Adds action (keep, remove), reason and explanation to classified comments; `protected` patterns may give them another kind first."""
    raw, kind = F.col("raw"), F.col("kind")
    claimed = F.lit(None).cast("string")
    why = F.lit(None).cast("string")
    for text, reason, tier in reversed(options.protected):
        claimed = F.when(raw.contains(text), F.lit("load-bearing" if tier == "load-bearing" else "directive")).otherwise(claimed)
        why = F.when(raw.contains(text), F.lit(reason)).otherwise(why)
    out = comments.withColumn("claimed", why).withColumn("kind", F.coalesce(claimed, kind) if options.protected else kind)
    protect = protection(kind)
    keep_kind = kind.isin(*options.keep_kinds) if options.keep_kinds else F.lit(False)
    keep_regex = first_match(raw, options.keep_regex).isNotNull()
    remove_kind = kind.isin(*options.remove_kinds) if options.remove_kinds else F.lit(False)
    remove_regex = first_match(raw, options.remove_regex).isNotNull()
    guarded = protect.isNotNull() if not options.force_protected else F.lit(False)
    by_policy = policy_keeps(options.policy, kind)
    if options.force_protected and options.policy != "none":
        by_policy = by_policy & protect.isNull()
    explanation = (
        F.when(keep_kind, "kept-by-kind")
        .when(keep_regex, "kept-by-regex")
        .when(guarded & (protect == "preamble"), "protected-preamble")
        .when(guarded, "protected-load-bearing")
        .when(remove_kind, "removed-by-kind")
        .when(remove_regex, "removed-by-regex")
        .when(~by_policy, "removed-by-policy")
        .otherwise("kept-by-policy")
    )
    out = out.withColumn("explanation", fence(explanation))
    removed = F.col("explanation").startswith("removed")
    reason = (
        F.when(removed, F.lit(None))
        .when(F.col("explanation") == "kept-by-kind", "kept by keep_kind")
        .when(F.col("explanation") == "kept-by-regex", "kept by keep_regex")
        .when(F.col("explanation") == "protected-preamble", "required by the file's preamble")
        .when(F.col("explanation") == "protected-load-bearing", "read by the toolchain")
        .when(kind == "html-comment", "HTML comments are DOM-observable")
        .when(kind == "directive", "tool or language directive")
        .when(F.lit(options.policy == "none"), "policy none removes nothing")
        .otherwise("conservative policy")
    )
    out = out.withColumn("action", fence(F.when(removed, "remove").otherwise("keep")))
    return out.withColumn("reason", F.when(removed, F.lit(None)).otherwise(F.coalesce("claimed", reason))).drop("claimed")
