"""Joins that deal hot keys over several tasks, and connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import Scratch

#: At most so many keys are hot at once, and no key with fewer rows is.
HOT_KEYS, HOT_ROWS = 200, 200


def hot_keys(big: DataFrame, on: list[str]) -> DataFrame | None:
    """The keys that hold more than 1/HOT_KEYS of the rows, with the number of tasks to deal each over; none if there are none.

    There are fewer than HOT_KEYS by their definition, so they may be broadcast. Counts are pre-aggregated before the shuffle."""
    limit = max(HOT_ROWS, big.count() // HOT_KEYS)
    hot = big.groupBy(*on).agg(F.count("*").alias("c")).where(F.col("c") > limit).select(*on, F.ceil(F.col("c") / limit).cast("int").alias("_tasks"))
    rows = hot.collect()
    return big.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def dealt(big: DataFrame, on: list[str], hot: DataFrame | None, salt: str = "_salt") -> DataFrame:
    """big with a column that spreads the rows of hot keys; it follows from the row, so a task done again deals alike."""
    if hot is None:
        return big.withColumn(salt, F.lit(0))
    return big.join(F.broadcast(hot), on, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*big.columns), F.col("_tasks")).cast("int"), F.lit(0))).drop("_tasks")


def copied(small: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    """small's rows for each salt of their key."""
    if hot is None:
        return small.withColumn("_salt", F.lit(0))
    return small.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1))).drop("_tasks")


_ASK = object()


def hot_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", hot: DataFrame | None = _ASK) -> DataFrame:
    """big (a saved table, unless hot is given) joined with small, which has few rows for a key; how is inner or left."""
    hot = hot_keys(big, on) if hot is _ASK else hot
    if hot is None:
        return big.join(small, on, how)
    return dealt(big, on, hot).join(copied(small, on, hot), [*on, "_salt"], how).drop("_salt")


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(a, b) long -> (id, component): for each id of a link the smallest id that links reach.

    Each round takes the least label among neighbours, pre-aggregated before the shuffle, then jumps to the label's own label; the centre
    of a star of very many links and a label that very many ids share are dealt over several tasks. Rounds grow with the logarithm of
    the longest chain. Self links and repeated links are fine; no links give no rows. Each round is written to the shared folder.
    """
    both = scratch.save(links.where("a != b").select("a", "b").union(links.where("a != b").select(F.col("b"), F.col("a"))).distinct(), f"{name}-both")
    label = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), f"{name}-0")
    if both.isEmpty():
        return label
    centres, turn = hot_keys(both, ["b"]), 0
    while True:
        turn += 1
        named = label.select(F.col("id").alias("b"), "component")
        met = hot_join(both, named, ["b"], hot=centres)
        near = met.groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = label.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("low"))
        shared = hot_keys(label.select(F.col("component").alias("low")), ["low"])
        jump = label.select(F.col("id").alias("low"), F.col("component").alias("next"))
        step = hot_join(step, jump, ["low"], "left", hot=shared)
        new = scratch.save(step.select("id", "old", F.least("low", F.coalesce("next", "low")).alias("component")), f"{name}-{turn}")
        moved = new.where("old != component").limit(1).count()
        label = new.select("id", "component")
        scratch.drop(f"{name}-{turn - 1}")
        if not moved:
            scratch.drop(f"{name}-both")
            return label
