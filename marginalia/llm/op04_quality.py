"""Quality rules: repetition coverage.

Rolling 64-bit hashes of word windows of several lengths, all in numpy, tell which windows and lines occur more than once in their
text; the measure is the share of the text's word characters that lie inside them.

Defined results: a null, empty or blank text has no words, counts zero and is not kept. Repeated rows give repeated rows. Extra
columns of the input are ignored. A text is taken whole, whatever its length: hashing goes through it a megabyte at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm import text as T
from marginalia.session import ship

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Rules:
    """Shares in percent; a text fails where a share is above its limit."""

    least_words: int = 50
    repeat_words: int = 50
    #: (words in a window, most percent of word characters inside windows that occur twice or more)
    coverage: tuple[tuple[int, int], ...] = ((5, 40), (8, 30), (10, 25))
    #: most percent of word characters in lines that equal an earlier one
    dup_line_chars: int = 30
    #: most symbols for a hundred words
    symbols: int = 30


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup_chars array<long>, base_failed boolean, kept boolean"


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is there another like it; is there one before it."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    if len(keys):
        k = keys[order]
        same[1:] = k[1:] == k[:-1]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    pair = same.copy()
    pair[:-1] |= same[1:]
    again[order] = pair
    return again, later


def measure(texts: list[bytes | None], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each text; covered[n]: word characters and words inside windows of n words that the text has twice or more."""
    buf, at = T.join(texts)
    n = len(texts)
    begins, ends = T.spans(buf)
    doc = np.searchsorted(at, begins, "right") - 1
    first = np.concatenate([[0], np.cumsum(T.START[buf], dtype=np.int64)])
    chars = first[ends] - first[begins]
    count = lambda index, weights=None: np.bincount(index, weights, n).astype(np.int64)
    out = {"n_words": count(doc), "word_chars": count(doc, chars)}
    out["n_symbols"] = count(np.searchsorted(at, np.flatnonzero(_SYMBOL[buf]), "right") - 1)
    with np.errstate(over="ignore"):
        salt = T.mix(doc.astype(np.uint64) + np.uint64(1))
        h = T.hashes(buf, begins, ends)
        feeds = np.flatnonzero(buf == 10)
        lb, le = feeds[:-1] + 1, feeds[1:]
        w0, w1 = np.searchsorted(begins, lb), np.searchsorted(begins, le)
        held = w1 > w0
        lb, le, w0, w1 = lb[held], le[held], w0[held], w1[held]
        line_doc = np.searchsorted(at, lb, "right") - 1
        _, later = _twice(T.mix(T.hashes(buf, lb, le) + T.mix(line_doc.astype(np.uint64) + np.uint64(1))))
        out["n_dup_lines"] = count(line_doc[later])
        upto = np.concatenate([[0], np.cumsum(chars)])
        out["dup_line_chars"] = count(line_doc[later], (upto[w1] - upto[w0])[later])
        for length in lengths:
            win = T.windows(h, length)
            inside = np.zeros(len(h) + 1, np.int64)
            if len(win):
                whole = np.flatnonzero(doc[: len(win)] == doc[length - 1 :])
                again, _ = _twice(T.mix(win[whole] + salt[whole]))
                hit = whole[again]
                np.add.at(inside, hit, 1)
                np.add.at(inside, hit + length, -1)
            covered = np.cumsum(inside[:-1]) > 0
            out[f"words{length}"], out[f"chars{length}"] = count(doc[covered]), count(doc[covered], chars[covered])
    return out


def _rows(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    lengths = tuple(dict.fromkeys((3, *(n for n, _ in rules.coverage))))
    for batch in batches:
        ids, texts = batch.column(0), T.blobs(batch.column(1))
        for i, j in T.chunks(texts):
            m = measure(texts[i:j], lengths)
            words, chars = m["n_words"], m["word_chars"]
            failed = (words < rules.least_words) | (100 * m["words3"] > rules.repeat_words * words)
            kept = ~failed & (100 * m["dup_line_chars"] <= rules.dup_line_chars * chars) & (100 * m["n_symbols"] <= rules.symbols * words)
            for n, most in rules.coverage:
                kept &= 100 * m[f"chars{n}"] <= most * chars
            dup = np.stack([m[f"chars{n}"] for n, _ in rules.coverage], 1) if rules.coverage else np.zeros((j - i, 0), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * dup.shape[1]), pa.array(dup.ravel()))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), *(pa.array(m[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines")), pa.array(m["words3"]), pa.array(m["dup_line_chars"]), lists, pa.array(failed), pa.array(kept)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "dup_chars", "base_failed", "kept"],
            )


def quality(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict for each row of docs; a map without a shuffle."""
    ship(docs.sparkSession)
    rules = rules or Rules()
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(T.tidy(lambda it: _rows(it, rules)), SCHEMA)


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of documents that the rules keep, with all their columns, by the same pass.

    The text goes to Python and back once, so the verdict needs no join on doc_id and repeated or null ids do no harm.
    """
    ship(docs.sparkSession)
    rules = rules or Rules()
    names = docs.columns
    at = names.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pa.array(np.arange(batch.num_rows, dtype=np.int64))
            part = pa.RecordBatch.from_arrays([place, batch.column(at)], ["doc_id", "text"])
            kept = [r.filter(r.column(9)).column(0) for r in _rows(iter([part]), rules)]
            yield batch.take(pa.concat_arrays(kept) if kept else pa.array([], pa.int64()))

    return docs.mapInArrow(T.tidy(good), docs.schema)


#: The whole result in DuckDB SQL, with the parameters of Rules().
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT doc_id, pos, word, length(word) AS chars,
        count(*) OVER (PARTITION BY doc_id) AS n,
        list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS g3,
        list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g5,
        list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g8,
        list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g10 FROM w),
t AS (SELECT doc_id, pos, chars,
        (pos + 2 <= n AND count(*) OVER (PARTITION BY doc_id, g3) > 1)::INT AS t3,
        (pos + 4 <= n AND count(*) OVER (PARTITION BY doc_id, g5) > 1)::INT AS t5,
        (pos + 7 <= n AND count(*) OVER (PARTITION BY doc_id, g8) > 1)::INT AS t8,
        (pos + 9 <= n AND count(*) OVER (PARTITION BY doc_id, g10) > 1)::INT AS t10 FROM g),
c AS (SELECT doc_id, chars,
        max(t3) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
        max(t5) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5,
        max(t8) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8,
        max(t10) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10 FROM t),
a AS (SELECT doc_id, count(*) AS n_words, sum(chars) AS word_chars, sum(c3) AS n_repeat_words,
        sum(chars * c5) AS d5, sum(chars * c8) AS d8, sum(chars * c10) AS d10 FROM c GROUP BY doc_id),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth
      FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d))
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
b AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_line_chars FROM l WHERE nth > 1 GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
        [coalesce(d5, 0)::BIGINT, coalesce(d8, 0)::BIGINT, coalesce(d10, 0)::BIGINT] AS dup_chars
      FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * dup_line_chars <= 30 * word_chars AND 100 * n_symbols <= 30 * n_words
  AND 100 * dup_chars[1] <= 40 * word_chars AND 100 * dup_chars[2] <= 30 * word_chars AND 100 * dup_chars[3] <= 25 * word_chars AS kept
FROM r
"""
