"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all bytes above 127. All n-grams of the test items are seeds, frequent
ones too: an edited copy may hold no others, however many documents hold it. A document with a seed is aligned with the item around it,
word by word: a match scores 1, a mismatch or a gap -1. A place with fewer words of the item than the least score is not aligned, as it
can't reach it. A document counts as contaminated where the best local alignment scores at least `similar` of the item's words. So copies
with words put in, left out or replaced are found as well as exact ones, and documents that only share a phrase are not.

The items are a stated query set: they are taken in blocks of at most BLOCK_ITEMS items and BLOCK_WORDS words, each block is sent to the
executors and held against all rows in one map. Nothing is shuffled.

Defined results: null and empty texts and items match nothing; an item with fewer words than a seed has one seed, all of it; repeated
items each match; repeated rows give repeated rows; extra columns are ignored; texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import text as T
from marginalia.session import ship

BLOCK_ITEMS = 20_000
BLOCK_WORDS = 2_000_000
_APART = np.ones(256, bool)
_APART[128:] = False
_APART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


@dataclass(frozen=True)
class Rules:
    seed_words: int = 3
    similar: float = 0.5
    #: an alignment of fewer words counts only if it is all of the item
    least_words: int = 8


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each word."""
    buf, at = T.join(texts)
    buf = T.LOWER[buf]
    apart = _APART[buf]
    edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    begins, ends = edges[0::2], edges[1::2]
    return np.searchsorted(at, begins, "right") - 1, T.hashes(buf, begins, ends)


def grams(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the n-grams that lie in one text."""
    win = T.windows(h, n)
    first = np.flatnonzero(owner[: len(win)] == owner[n - 1 :]) if len(win) else np.empty(0, np.int64)
    return first, win[first]


def align(item: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of the item against each row of word hashes (0 pads), and the column after its end."""
    count, width = rows.shape
    slope = np.arange(width, dtype=np.int32)
    above = np.zeros((count, width + 1), np.int32)
    best, end = np.zeros(count, np.int32), np.zeros(count, np.int32)
    for w in item:
        step = np.where(rows == w, 1, -1).astype(np.int32)
        now = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] - 1), 0)
        now = np.maximum.accumulate(now + slope, 1) - slope  # gaps along the row
        above[:, 1:] = now
        top = now.argmax(1)
        value = now[np.arange(count), top]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
    return best, end


class Items:
    """A block of test items with the seeds to look for."""

    def __init__(self, ids: list[int], texts: list[bytes], rules: Rules):
        owner, h = words(texts)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.ids, self.rules = np.array(ids, np.int64), rules
        self.words = [h[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
        first, key = grams(owner, h, rules.seed_words)
        item = owner[first]
        offset = first - cuts[item]
        self.vocabulary = [np.unique(w) for w in self.words]
        order = np.lexsort((offset, item, key))
        self.key, self.item, self.offset = key[order], item[order], offset[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.key & np.uint64((1 << 20) - 1)] = True
        # items too short for a seed, by their number of words
        self.brief: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(self.words):
            if 0 < len(w) < self.rules.seed_words:
                self.brief.setdefault(len(w), {}).setdefault(int(T.windows(w, len(w))[0]), []).append(i)

    def hits(self, first: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word in the texts, index of the seed) of every seed found."""
        some = np.flatnonzero(self.maybe[key & np.uint64((1 << 20) - 1)])
        lo, hi = np.searchsorted(self.key, key[some]), np.searchsorted(self.key, key[some], "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(first[some], n), at

    def search(self, texts: list[bytes | None]) -> list[tuple[int, int, int, int, int]]:
        """(text index, item index, score, first word, word after the last) of the best alignment of each pair that is similar."""
        owner, h = words(texts)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        first, seed = self.hits(*grams(owner, h, self.rules.seed_words))
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, known in self.brief.items():
            at, key = grams(owner, h, n)
            table = np.array(list(known), np.uint64)
            for i in np.flatnonzero(np.isin(key, table)):
                t = int(owner[at[i]])
                for item in known[int(key[i])]:
                    out.setdefault((t, item), (n, int(at[i] - cuts[t]), int(at[i] - cuts[t]) + n))
        item, text = self.item[seed], owner[first]
        begin = first - self.offset[seed]
        order = np.lexsort((begin, text, item))
        item, text, begin = item[order], text[order], begin[order]
        edges = np.flatnonzero(np.diff(item, prepend=-1))
        for lo, hi in zip(edges.tolist(), np.append(edges[1:], len(item)).tolist(), strict=False):
            self._align(int(item[lo]), text[lo:hi], begin[lo:hi], h, cuts, out)
        return [(t, i, *x) for (t, i), x in sorted(out.items())]

    def _align(self, item: int, text: np.ndarray, begin: np.ndarray, h: np.ndarray, cuts: np.ndarray, out: dict) -> None:
        want = self.words[item]
        slack = len(want) // 2 + 4
        # hits that suggest about the same place are one window
        low, high = np.maximum(begin - slack, cuts[text]), np.minimum(begin + len(want) + slack, cuts[text + 1])
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (begin[1:] - begin[:-1] > slack)
        head = np.flatnonzero(new)
        low, high, text = low[head], np.maximum.reduceat(high, head), text[head]
        least = max(self.rules.similar * len(want), min(self.rules.least_words, len(want)))
        size = high - low
        own = self.vocabulary[item]
        for group in np.array_split(np.argsort(size, kind="stable"), max(1, int(size.max() * len(size)) // 2_000_000 + 1)):
            if not len(group):
                continue
            width = int(size[group].max())
            place = low[group][:, None] + np.arange(width)
            inside = place < high[group][:, None]
            rows = np.where(inside, h[np.minimum(place, len(h) - 1)], np.uint64(0))
            # no more words match than the place has of the item's
            able = (own[np.minimum(np.searchsorted(own, rows), len(own) - 1)] == rows).sum(1) >= least
            group, rows = group[able], rows[able]
            if not len(group):
                continue
            score, end = align(want, rows)
            for g in np.flatnonzero(score >= least):
                w, t = group[g], int(text[group[g]])
                back, length = align(want[::-1], rows[g : g + 1, : end[g]][:, ::-1])
                stop = int(low[w] - cuts[t]) + int(end[g])
                found = (int(score[g]), stop - int(length[0]), stop)
                if (t, item) not in out or out[t, item][0] < found[0]:
                    out[t, item] = found


def blocks(benchmark: DataFrame, rules: Rules, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The test items in blocks of bounded size, one block in the driver at a time."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for row in benchmark.select(F.col(id_col).cast("long"), text_col).where(f"`{id_col}` IS NOT NULL AND `{text_col}` IS NOT NULL").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1].encode())
        size += row[1].count(" ") + 1
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_WORDS:
            yield Items(ids, texts, rules)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, rules)


SCHEMA = "doc_id long, item_id long, score long, item_words long, similarity double, first_word long, end_word long"


def find(docs: DataFrame, benchmark: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and test item that it holds a copy of: the alignment's score, share of the item and place in words."""
    spark = docs.sparkSession
    ship(spark)
    rules = rules or Rules()
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for items in blocks(benchmark, rules):

        def search(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), T.blobs(batch.column(1))
                for i, j in T.chunks(texts):
                    rows = [(ids[i + t], int(items.ids[k]), s, len(items.words[k]), s / len(items.words[k]), a, b) for t, k, s, a, b in items.search(texts[i:j])]
                    if rows:
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "score", "item_words", "similarity", "first_word", "end_word"])

        out = out.unionByName(docs.mapInArrow(T.tidy(search), SCHEMA))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of documents that hold no copy of a test item; a map for each block of items, without a join on doc_id."""
    ship(docs.sparkSession)
    rules = rules or Rules()
    at = docs.columns.index("text")
    for items in blocks(benchmark, rules):

        def clean(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = T.blobs(batch.column(at))
                bad = {i + hit[0] for i, j in T.chunks(texts) for hit in items.search(texts[i:j])}
                yield batch.filter(pa.array([k not in bad for k in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(T.tidy(clean), docs.schema)
    return docs
