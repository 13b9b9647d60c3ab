"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of ids, at first one for each byte. Every adjacent pair whose bytes together are a token stands in the
bucket of that token's rank. A bitmap of the ranks, with bitmaps of its words above it, gives the lowest rank that has a bucket by
find-first-set. Its bucket is taken whole, left to right; entries whose pair has changed meanwhile are skipped; each merge relinks the
list and queues its two new pairs. So a pre-token of n bytes takes O(n log n) however long it is, and many pre-tokens share one queue:
they lie in one buffer with breaks between them, and a rank's merges in all of them are one numpy step.

A rank's bucket is taken whole as long as its merges make no pair of a lower rank. Where one does, the later entries of that pre-token wait
in the bucket until the lower rank is done. A bucket with few entries is taken one by one.

Texts are cut into pieces before each run of white space, where a match of the pattern begins anyway (see `fits`), and a worker keeps the
ids of the pieces that it meets, by hash; the bytes of every piece are compared with those kept. Only new pieces go through the pattern
and the queue. Ids of pieces, texts and their spellings are numpy arrays with offsets; no list is made for a piece. Decoding joins the
ids' bytes.

Defined results: null is as empty; no tokens for an empty text; texts of any length are whole; repeated rows give repeated rows;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from marginalia.llm import text as T
from marginalia.session import ship

#: Pieces that a worker remembers, and their bytes; when full it starts anew. A matter of speed only.
REMEMBERED, REMEMBERED_BYTES = 600_000, 16 << 20
#: Bytes of texts whose new pieces go through one queue.
TOGETHER = 2 << 20
#: Bytes of pre-tokens in one queue; it takes about fifty times as much.
QUEUED = T.CHUNK
#: Tokens that are spelled out at once.
SPELLED = 1 << 18
#: Entries up to which a bucket is taken one by one.
FEW = 16


def load_ranks(path: str) -> list[bytes]:
    """The tokens by id, from a file of lines of base64 and rank."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                found[int(rank)] = base64.b64decode(token)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [found[i] for i in range(len(found))]


class Bitmap:
    """A set of ranks with find-first-set: bitmaps of 64-bit words, each level marking the words of the one below that aren't empty."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) // 64
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, i: int) -> None:
        for level in self.levels:
            i, bit = i >> 6, i & 63
            old = level[i]
            level[i] = old | 1 << bit
            if old:
                return

    def remove(self, i: int) -> None:
        for level in self.levels:
            i, bit = i >> 6, i & 63
            level[i] &= ~(1 << bit)
            if level[i]:
                return

    def first(self) -> int:
        """The lowest member, or -1."""
        if not self.levels[-1][0]:
            return -1
        i = 0
        for level in reversed(self.levels):
            word = level[i]
            i = i << 6 | (word & -word).bit_length() - 1
        return i


def edges(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin, and the end."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def taken(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes of the runs that begin there and have these sizes, run after run."""
    at = edges(sizes)
    return np.repeat(begin - at[:-1], sizes) + np.arange(at[-1])


def runs(held: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items, whose edges are given, of about that size together; a larger item stands alone."""
    lo = 0
    while lo < len(held) - 1:
        hi = max(lo + 1, int(np.searchsorted(held, held[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


class Table:
    """Rows by distinct 64-bit hash, with open addressing; all look-ups of a batch go on together. It grows to stay half empty."""

    def __init__(self, bits: int = 16):
        self.bits, self.held = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where there is none."""
        out, h, todo = np.full(len(h), -1, np.int64), np.maximum(h, np.uint64(1)), None
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(slot):
            k = self.keys[slot]
            hit = k == h
            out[hit if todo is None else todo[hit]] = self.rows[slot[hit]]
            on = np.flatnonzero(~hit & (k != 0))
            todo = on if todo is None else todo[on]
            h, slot = h[on], (slot[on] + 1) & (1 << self.bits) - 1
        return out

    def add(self, h: np.ndarray, rows: np.ndarray) -> None:
        """Distinct hashes that it doesn't hold yet."""
        self.held += len(h)
        if 2 * self.held > len(self.keys):
            old = np.flatnonzero(self.keys)
            h, rows = np.concatenate([self.keys[old], h]), np.concatenate([self.rows[old], rows])
            self.__init__((2 * self.held).bit_length())
            self.held = len(h)
        h = np.maximum(h, np.uint64(1))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(slot):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]  # of several for one place the last has it
            there = free & (self.keys[slot] == h)
            self.rows[slot[there]] = rows[there]
            h, rows, slot = h[~there], rows[~there], (slot[~there] + 1) & (1 << self.bits) - 1


class Spelling:
    """Byte strings by id in one buffer."""

    def __init__(self, parts: list[bytes]):
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.begin = edges(self.size)[:-1]
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def digests(self, ids: np.ndarray, counts: np.ndarray, skip: int) -> list[str]:
        """For each text (its ids follow those of the one before) the SHA-256 of what its ids spell without the first `skip` bytes."""
        at = edges(counts)
        out = [hashlib.sha256() for _ in range(len(counts))]
        for lo in range(0, len(ids), SPELLED):
            part = ids[lo : lo + SPELLED]
            size = self.size[part]
            data = self.data[taken(self.begin[part], size)]
            where, hi = edges(size), lo + len(part)
            k = int(np.searchsorted(at, lo, "right")) - 1
            to = int(np.searchsorted(at, hi, "left"))
            bounds = np.clip(at[k : to + 1], lo, hi) - lo
            begins = where[bounds[:-1]] + np.where((at[k:to] >= lo) & (bounds[1:] > bounds[:-1]), skip, 0)
            for x, a, b in zip(out[k:to], begins.tolist(), where[bounds[1:]].tolist(), strict=True):
                if a < b:
                    x.update(data[a:b])
        return [x.hexdigest() for x in out]


class Bpe:
    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.fits = fits(pattern)
        self.whole = ids = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        left, right, whole = [], [], []
        for t, i in ids.items():
            for cut in range(1, len(t)):
                a, b = ids.get(t[:cut]), ids.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(i)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        keys, ranks = keys[order], np.array(whole, np.int64)[order]
        self.pairs = dict(zip(keys.tolist(), ranks.tolist(), strict=True))
        self.keys, self.ranks = np.append(keys, np.iinfo(np.int64).max), np.append(ranks, -1)  # the last is beyond all pairs
        # the rank of each pair of bytes
        self.bytes = np.array([ids.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        # decimal ids with a comma before each
        self.decimal, self.spelled = Spelling([b",%d" % i for i in range(len(tokens))]), Spelling(tokens)
        self.forget()

    def forget(self) -> None:
        """Drop the pieces met so far: a table of their hashes' rows, and by row their bytes and ids."""
        self.table = Table()
        self.data, self.data_begin = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it isn't a token; with a negative id on either side the key is negative, as no token's is."""
        want = left << 32 | right
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.ranks[at], -1)

    def encode_all(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in order and how many each has, by one queue for all of them."""
        n = len(pretokens)
        sizes = np.fromiter(map(len, pretokens), np.int64, n)
        # a break (-1) before, between and after the pre-tokens
        begins = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
        ids = np.full(int(begins[-1]), -1, np.int64)
        raw = np.frombuffer(b"".join(pretokens), np.uint8)
        place = np.arange(len(raw)) + np.repeat(np.arange(n), sizes) + 1
        ids[place] = self.byte[raw]
        size = len(ids)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        pair = np.full(size, -1, np.int64)  # the rank of the pair that begins here
        if len(raw) > 1:
            first = self.bytes[raw[:-1].astype(np.int64) << 8 | raw[1:]]
            first[place[1:] != place[:-1] + 1] = -1
            pair[place[:-1]] = first
        bitmap = Bitmap(len(self.tokens))
        small = np.uint16 if len(self.tokens) <= 1 << 16 else np.int64  # 16 bits are sorted by radix
        buckets: dict[int, tuple[list[np.ndarray], list[int]]] = {}  # positions, many or one at a time

        def bucket(rank: int) -> tuple[list[np.ndarray], list[int]]:
            found = buckets.get(rank)
            if found is None:
                found = buckets[rank] = [], []
                bitmap.add(rank)
            return found

        def queue(at: np.ndarray, ranks: np.ndarray) -> None:
            ok = np.flatnonzero(ranks >= 0)
            if len(ok) <= FEW:
                for r, p in zip(ranks[ok].tolist(), at[ok].tolist(), strict=True):
                    bucket(r)[1].append(p)
                return
            ok = ok[np.argsort(ranks[ok].astype(small), kind="stable")]
            at, ranks = at[ok], ranks[ok]
            edge = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            low = [0, *edge.tolist()]
            every = at.tolist()
            for r, lo, hi in zip(ranks[low].tolist(), low, [*low[1:], len(at)], strict=True):
                if hi - lo <= FEW:
                    bucket(r)[1].extend(every[lo:hi])
                else:
                    bucket(r)[0].append(at[lo:hi])

        queued = np.flatnonzero(pair >= 0)
        queue(queued, pair[queued])
        get = self.pairs.get
        while (rank := bitmap.first()) >= 0:
            bitmap.remove(rank)
            arrays, ones = buckets.pop(rank)
            if not arrays and len(ones) <= FEW:
                ones.sort()
                for k, p in enumerate(ones):
                    if pair.item(p) != rank:  # a stale entry
                        continue
                    gone = after.item(p)
                    then, prior = after.item(gone), before.item(p)
                    ids[p], ids[gone], pair[gone], after[p], before[then] = rank, -2, -1, then, p
                    right, left = ids.item(then), ids.item(prior)
                    right = get(rank << 32 | right, -1) if right >= 0 else -1
                    left = get(left << 32 | rank, -1) if left >= 0 else -1
                    pair[p], pair[prior] = right, left
                    if right >= 0:
                        bucket(right)[1].append(p)
                    if left >= 0:
                        bucket(left)[1].append(prior)
                    if 0 <= right < rank or 0 <= left < rank:
                        # what ranks lower comes before the later entries
                        if ones[k + 1 :]:
                            bucket(rank)[1].extend(ones[k + 1 :])
                        break
                continue
            if ones:
                arrays.append(np.array(ones, np.int64))
            at = np.concatenate(arrays)
            at = at[pair[at] == rank]  # stale entries go
            at.sort()
            if len(at) > 1 and (same := at[1:] == at[:-1]).any():
                at = at[np.append(True, ~same)]
            every = at
            if not len(at):
                continue
            # of pairs that overlap, as in a run of one character, every second one from the left
            chained = after[at[:-1]] == at[1:]
            if chained.any():
                head = np.flatnonzero(np.append(True, ~chained))
                step = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
                at = at[step % 2 == 0]
            gone = after[at]
            then = after[gone]
            same = np.full(len(at), rank)
            ahead = ids[before[at]]
            met = then[:-1] == at[1:]  # the neighbour behind is merged in this step too
            some = met.any()
            if some:
                ahead[1:][met] = rank
            right, left = self.rank_of(np.concatenate([same, ahead]), np.concatenate([ids[then], same])).reshape(2, -1)
            low = ((left >= 0) & (left < rank)) | ((right >= 0) & (right < rank))
            if low.any():
                # a merge whose new pair ranks below it comes before the later entries of its pre-token
                first = np.full(n + 2, size)
                np.minimum.at(first, np.searchsorted(begins, at[low], "right"), at[low])
                bucket(rank)[0].append(every[every > first[np.searchsorted(begins, every, "right")]])
                stay = at <= first[np.searchsorted(begins, at, "right")]
                at, gone, then, left, right = at[stay], gone[stay], then[stay], left[stay], right[stay]
            ids[at], ids[gone], pair[gone], after[at], before[then] = rank, -2, -1, then, at
            if some:
                met = ids[then] == rank
                right[met] = self.rank_of(ids[at[met]], ids[then[met]])
            prior = before[at]
            pair[at], pair[prior] = right, left
            queue(np.concatenate([at, prior]), np.concatenate([right, left]))
        alive = np.flatnonzero(ids >= 0)
        return ids[alive].astype(np.int32), np.diff(np.searchsorted(alive, begins))

    # ---- texts --------------------------------------------------------------------------------------------------------------------

    def pieces(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text of the pieces of texts that T.join laid out: whole texts, or cut before white space where the pattern fits."""
        start, stop = at[:-1], at[1:] - 1
        begins = start[stop > start]
        if self.fits:
            white = T.SEPARATOR[buf]
            cuts = np.flatnonzero(white[1:] & ~white[:-1]) + 1
            wide = np.flatnonzero(buf[cuts - 1] >= 0x80)
            cuts = np.delete(cuts, wide[_ends_white(buf, cuts[wide])])
            cuts = cuts[~np.isin(cuts, stop, assume_unique=True)] if len(cuts) < 64 else np.delete(cuts, _found(cuts, stop))
            begins = np.sort(np.concatenate([begins, cuts]), kind="stable")
        owner = np.searchsorted(at, begins, "right") - 1
        return begins, np.minimum(np.append(begins[1:], len(buf)), stop[owner]), owner

    def learn(self, raw: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these pieces in order and how many each has; their pre-tokens go through one queue."""
        buf = np.frombuffer(raw, np.uint8)
        # white space and then other characters: side by side such pieces are split as each for itself
        plain = T.SEPARATOR[buf[begins]] & ~T.SEPARATOR[buf[ends - 1]] & self.fits
        plain[plain] &= ~_ends_white(buf, ends[plain])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        bounds = list(zip(begins[order].tolist(), ends[order].tolist(), strict=True))
        together = int(plain.sum())
        seen: dict[str, int] = defaultdict(count().__next__)
        some, held = [np.empty(0, np.int64)], np.zeros(len(begins), np.int64)
        for lo, hi in runs(edges((ends - begins)[order[:together]]), T.CHUNK // 4):
            found = self.pattern.findall(b"".join([raw[a:b] for a, b in bounds[lo:hi]]).decode())
            some.append(np.fromiter(map(seen.__getitem__, found), np.int64, len(found)))
            del found
        owners = [np.concatenate(some)]
        for k, (a, b) in enumerate(bounds[together:], together):
            found = self.pattern.findall(raw[a:b].decode())
            held[k] = len(found)
            owners.append(np.fromiter(map(seen.__getitem__, found), np.int64, len(found)))
        pretokens = [p.encode() for p in seen]
        size = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        done = np.cumsum(size[owners[0]])
        held[:together] = np.diff(np.searchsorted(done, np.cumsum((ends - begins)[order[:together]]), "right"), prepend=0)
        # back to the pieces' order
        at, owner = np.empty(len(begins), np.int64), np.concatenate(owners)
        at[order], held[order] = edges(held)[:-1], held.copy()
        owner = owner[taken(at, held)]
        # ids of the distinct pre-tokens
        whole = np.fromiter((self.whole.get(p, -1) for p in pretokens), np.int64, len(pretokens))
        rest = np.flatnonzero(whole < 0)
        ids, sizes = [whole.astype(np.int32)], np.ones(len(pretokens), np.int64)
        begin, end = np.arange(len(pretokens)), len(pretokens)
        left = [pretokens[i] for i in rest.tolist()]
        for lo, hi in T.chunks(left, QUEUED):
            some, n = self.encode_all(left[lo:hi])
            ids.append(some)
            sizes[rest[lo:hi]], begin[rest[lo:hi]] = n, end + edges(n)[:-1]
            end += len(some)
        n = sizes[owner]
        return np.concatenate(ids)[taken(begin[owner], n)], np.diff(edges(n)[edges(held)])

    def _rows(self, buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """The row of each piece in the memory, new ones learned; none if two different pieces have one hash."""
        h = T.hashes(buf, begins, ends)
        row = self.table.find(h)
        fresh = np.flatnonzero(row < 0)
        if len(fresh):
            new, one, which = np.unique(h[fresh], return_index=True, return_inverse=True)
            b, e = begins[fresh[one]], ends[fresh[one]]
            ids, n = self.learn(buf.tobytes(), b, e)
            rows = len(self.begin) - 1 + np.arange(len(new))
            row[fresh] = rows[which]
            self.table.add(new, rows)
            self.ids, self.begin = np.concatenate([self.ids, ids]), np.concatenate([self.begin, self.begin[-1] + np.cumsum(n)])
            self.data = np.concatenate([self.data, *(buf[taken(b[i:j], (e - b)[i:j])] for i, j in runs(edges(e - b), T.CHUNK // 4))])
            self.data_begin = np.concatenate([self.data_begin, self.data_begin[-1] + np.cumsum(e - b)])
        return row if same(buf, begins, ends, self.data, self.data_begin[row], self.data_begin[row + 1]) else None

    def encode_texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many each has."""
        buf, at = T.join(texts)
        begins, ends, owner = self.pieces(buf, at)
        row = self._rows(buf, begins, ends)
        if row is None:
            ids, n = self.learn(buf.tobytes(), begins, ends)
        else:
            n = (self.begin[row + 1] - self.begin[row]).astype(np.int32)
            ids = self.ids[taken(self.begin[row], n)]
            if len(self.begin) > REMEMBERED or len(self.data) > REMEMBERED_BYTES:
                self.forget()
        return ids, np.bincount(owner, n, len(texts)).astype(np.int64)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts([(text or "").encode()])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def _ends_white(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether white space beyond ASCII ends there: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000."""
    z = buf[ends - 1]
    y, x = buf[np.maximum(ends - 2, 0)], buf[np.maximum(ends - 3, 0)]
    out = (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
    out |= (x == 0xE1) & (y == 0x9A) & (z == 0x80)
    out |= (x == 0xE2) & (y == 0x80) & ((z >= 0x80) & (z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    return out | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80)


def _found(ascending: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted values stand among ascending distinct ones."""
    at = np.searchsorted(ascending, wanted)
    at = at[at < len(ascending)]
    return at[np.isin(ascending[at], wanted)]


def same(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, other: np.ndarray, theirs: np.ndarray, to: np.ndarray) -> bool:
    """Whether all these spans have the same bytes as their counterparts."""
    size = ends - begins
    if not np.array_equal(size, to - theirs):
        return False
    return all(np.array_equal(buf[taken(begins[lo:hi], size[lo:hi])], other[taken(theirs[lo:hi], size[lo:hi])]) for lo, hi in runs(edges(size), T.CHUNK // 4))


#: Alternatives besides the runs of white space under which no match goes on over white space but for one space that begins it.
_SIMPLE = re.compile(r"(?: \?)?(?:'[a-z]+|\\p\{[LN]\}\+|\[\^\\s\\p\{L\}\\p\{N\}\]\+)")


def fits(pattern: str) -> bool:
    """Whether texts may be cut before runs of white space without other matches: a run stands in matches of its own, all but its last
    character where something follows, and nothing else but that last character, if it's a space, goes into a match with what follows."""
    *others, trail, run = pattern.split("|") if pattern.count("|") > 1 else ("", "", "")
    return (trail, run) == (r"\s+(?!\S)", r"\s+") and all(map(_SIMPLE.fullmatch, others))


_cached: dict[tuple[str, str], Bpe] = {}


def bpe(path: str, pattern: str) -> Bpe:
    if (path, pattern) not in _cached:
        _cached[path, pattern] = Bpe(load_ranks(path), pattern)
    return _cached[path, pattern]


def encoded(batch: pa.RecordBatch, coder: Bpe) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, ids, number of each row's ids) of the texts in the batch's second column."""
    texts = batch.column(1).cast(pa.large_binary())
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, edges(sizes)
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(held, held[lo] + TOGETHER, "right")) - 1)
        yield lo, hi - lo, *coder.encode_texts(texts.slice(lo, hi - lo).to_pylist())
        lo = hi


def _mapped(docs: DataFrame, id_col: str, text_col: str, rows: Callable, schema: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(T.tidy(rows), schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>. A map without a shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            for at, size, ids, n in encoded(batch, coder):
                lists = pa.ListArray.from_arrays(pa.array(edges(n), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, size), lists], ["doc_id", "ids"])

    return _mapped(docs, id_col, text_col, rows, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, the digest of the decimal ids and of the bytes that the ids decode to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            for at, size, ids, n in encoded(batch, coder):
                columns = [pa.array(n, pa.int64()), pa.array(coder.decimal.digests(ids, n, 1), pa.string()), pa.array(coder.spelled.digests(ids, n, 0), pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, size), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, id_col, text_col, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
