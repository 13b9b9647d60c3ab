"""Live documents: versioned edits as a stream, the documents as its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.lexing import scan
from marginalia.session import ship

EDITS = "uri string, version long, seq int, span_start long, span_end long, replacement binary, language string"
EVENTS = "uri string, version long, accepted boolean, problem string, size long, comments int, errors int"
STATE = "content binary, version long, language string"


def splice(content: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """Edits one after the other, each against what the one before it left; a span out of bounds is an error."""
    for a, b, new in edits:
        if a < 0 or b < a or b > len(content):
            raise ValueError("span out of bounds")
        content = content[:a] + new + content[b:]
    return content


def follow(state: tuple[bytes, int, str] | None, batches: list[tuple[int, str | None, list[tuple[int, int, bytes]]]]) -> tuple[tuple[bytes, int, str] | None, list[dict]]:
    """Take the versions in order of arrival: one that isn't newer, or has a wrong span, changes nothing and says so. An edit without a
    start replaces the whole document."""
    events = []
    for version, language, edits in batches:
        content, current, known = state or (b"", -1, language or "")
        event = {"version": version, "accepted": False, "problem": None, "size": len(content), "comments": None, "errors": None}
        if version <= current:
            event["problem"] = "stale version"
        else:
            try:
                for a, b, new in edits:
                    content = new if a is None else splice(content, [(a, b, new)])
                known = language or known
                found, wrong = scan(content, known)
                state = (content, version, known)
                event |= {"accepted": True, "size": len(content), "comments": len(found), "errors": len(wrong)}
            except ValueError as e:
                event["problem"] = str(e)
        events.append(event)
    return state, events


def _update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["version", "seq"], kind="stable")
    batches = []
    for version, part in rows.groupby("version", sort=True):
        edits = [(None if pd.isna(a) else int(a), None if pd.isna(b) else int(b), bytes(r) if r is not None else b"") for a, b, r in zip(part["span_start"], part["span_end"], part["replacement"], strict=True)]
        language = next((x for x in part["language"] if isinstance(x, str)), None)
        batches.append((int(version), language, edits))
    old = state.get if state.exists else None
    new, events = follow((bytes(old[0]), old[1], old[2]) if old else None, batches)
    if new:
        state.update((bytearray(new[0]), new[1], new[2]))
    out = pd.DataFrame(events)
    out.insert(0, "uri", key[0])
    yield out.astype({"comments": "Int32", "errors": "Int32"})


def live(edits: DataFrame) -> DataFrame:
    """A row for each version of each document: was it taken, and what does the document hold now. edits: a stream of EDITS."""
    ship(edits.sparkSession)
    return edits.groupBy("uri").applyInPandasWithState(_update, EVENTS, STATE, "append", "NoTimeout")


def accepted_versions(edits: DataFrame, key: str, version: str, *order: str) -> DataFrame:
    """The batch form of stale rejection: in order of arrival, a version is taken if it is above all before it."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.max(version).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return edits.withColumn("accepted", before.isNull() | (F.col(version) > before))


def to_bytes(content: bytes, line: int, character: int, encoding: str = "utf-16") -> int:
    """The byte offset of a 0-based (line, character) position; characters are counted in the units of the encoding."""
    at = 0
    for _ in range(line):
        ends = [(content.find(e, at), len(e)) for e in (b"\r\n", b"\n", b"\r") if content.find(e, at) >= 0]
        if not ends:
            raise ValueError("line out of bounds")
        first = min(p for p, _ in ends)
        at = first + max(n for p, n in ends if p == first)
    text = content[at:].decode("utf-8", "replace")
    units = 0
    for c in text:
        if units >= character or c in "\r\n":
            break
        units += {"utf-8": len(c.encode()), "utf-16": 1 + (ord(c) > 0xFFFF), "utf-32": 1}[encoding]
        at += len(c.encode())
    if units != character:
        raise ValueError("character out of bounds")
    return at
