"""Training-order materialisation of token ids as binary shards.

Each document's ids, an end id after them, are cut into sequences of `length` ids, the last one filled up. A keyed Feistel permutation with
cycle-walking gives each sequence's running number a global slot, so the training order is fixed by the key and any slot's place is known
without a table. Range partitions of the slots write the shards: shard k holds the slots from k * shard_slots on, in order, each in a record
of fixed stride, so a reader can start or go on at any slot by arithmetic, and reads sequentially from there.

A record is little-endian: doc_id (8 bytes), number of the sequence in its document (4, the highest bit set where the doc_id is null), ids
in it (4), the ids (2 bytes each, 4 where the vocabulary needs it), and a line feed, since Spark's text writer writes it: so tasks commit
through Hadoop's committer to any file system, a lost executor's work is done again, and no half shard is left.

Documents are encoded once. Each task of that pass writes its documents' ids to the shared folder with the running number of their first
sequence in the task; what is counted is one number for each task. The second pass reads what was written, so the numbers hold however the
input's rows were dealt and however often a task runs. Records cross the network in compressed packs, each for one cell: a shard, or a part
of one that is larger than what a task should hold. In packs ids are numbered by how frequent they are among the first ones of each task.

Defined results: a null or empty text is one sequence with the end only; a null doc_id stays null, negative ones are kept; repeated rows are
sequences of their own; extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import text as T
from marginalia.llm.op10_bpe import Bpe, Spelling, Table, edges, encoded, load_ranks, taken
from marginalia.session import Scratch, hand_back, ship, small_batches

LENGTH = 256
SHARD_SLOTS = 32_768
ROUNDS = 4
#: Rows in Python at once; batches also end at session.BATCH_BYTES.
BATCH = 10_000
#: Bytes of a pre-token up to which it is encoded side by side with others.
SHORT = 32
#: Records that are written at once.
RECORDS = 1 << 12
#: Records that are cut and packed at once, about, and bytes of shard that are filled at once, about.
PACK, CELL_BYTES = 1 << 15, 32 << 20
#: Ids of each task from which the frequent ones are told, and how hard packs are compressed; both matter for the packs' size only.
SEEN, LEVEL = 2048, 3


class Columns(Bpe):
    """Encodes short pre-tokens side by side, one merge of each at a time; longer ones go through the queue.

    Pre-tokens of as many symbols are the columns of one table, from those of the most symbols on. A column's pair of the lowest rank, of several
    the leftmost, is merged, so it moves to the table with one symbol less; a column without a pair that is a token is done. A pre-token of n
    bytes takes O(n * n), hence the limit SHORT."""

    #: The rank, shifted by this, and the place of a pair are one number; what isn't a token has a higher number than all ranks.
    SHIFT, NONE = 6, 1 << 30

    def __init__(self, tokens: list[bytes], pattern: str):
        super().__init__(tokens, pattern)
        if len(tokens) >= self.NONE >> self.SHIFT:
            raise ValueError("too many tokens")
        self.made = Table()
        self.made.add(self._key(self.keys[:-1] >> 32, self.keys[:-1] & 0xFFFFFFFF), self.ranks[:-1])
        self.first = self._ordered(self.bytes)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A pair as a number of 64 bits, other than 0; pairs of different ids have different ones, since the factor is odd."""
        return ((left.astype(np.uint64) + np.uint64(1)) << np.uint64(32) | right.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)

    def _ordered(self, ranks: np.ndarray) -> np.ndarray:
        return np.where(ranks >= 0, ranks << self.SHIFT, self.NONE).astype(np.int32)

    def encode_all(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        short, long = np.flatnonzero(sizes <= SHORT), np.flatnonzero(sizes > SHORT)
        some = [pretokens[i] for i in short.tolist()] if len(long) else pretokens
        n = np.zeros(len(pretokens), np.int64)
        done = list(self._tables(np.frombuffer(b"".join(some), np.uint8), sizes[short]))
        for who, ids in done:
            n[short[who]] = len(ids)
        queued, n[long] = super().encode_all([pretokens[i] for i in long.tolist()]) if len(long) else (np.empty(0, np.int32), 0)
        at = edges(n)
        out = np.empty(int(at[-1]), np.int32)
        out[taken(at[long], n[long])] = queued
        for who, ids in done:
            begin = at[short[who]]
            for k, row in enumerate(ids):
                out[begin + k] = row
        return out, n

    def _tables(self, raw: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pre-tokens that are done (their numbers) and their ids, a row for each symbol."""
        begin = edges(sizes)[:-1]
        by = np.argsort(sizes.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(sizes[by], np.arange(int(sizes.max(initial=0)) + 2))
        who, ids, pair = np.empty(0, np.int64), np.empty((0, 0), np.int32), np.empty((0, 0), np.int32)
        for m in range(len(cuts) - 2, 0, -1):
            fresh = by[cuts[m] : cuts[m + 1]]
            spelled = raw[begin[fresh] + np.arange(m)[:, None]]
            new = self.byte[spelled].astype(np.int32)
            two = self.first[spelled[:-1].astype(np.int64) << 8 | spelled[1:]]
            if len(who):
                who, ids, pair = np.concatenate([who, fresh]), np.concatenate([ids, new], axis=1), np.concatenate([pair, two], axis=1)
            else:
                who, ids, pair = fresh, new, two
            best = np.full(len(who), self.NONE, np.int32)
            for k in range(m - 1):
                np.minimum(best, pair[k] + k, out=best)
            over = best >= self.NONE
            if over.any():
                yield who[over], ids[:, over]
                on = np.flatnonzero(~over)
                who, ids, pair, best = who[on], ids[:, on], pair[:, on], best[on]
            # two symbols become one; what stands behind them moves up
            cut, rank = best & (1 << self.SHIFT) - 1, best >> self.SHIFT
            for k in range(m - 1):
                behind = cut <= k
                np.copyto(ids[k], ids[k + 1], where=behind)
                if k < m - 2:
                    np.copyto(pair[k], pair[k + 1], where=behind)
            ids, pair, column = ids[: m - 1], pair[: max(m - 2, 0)], np.arange(len(who))
            ids[cut, column] = rank
            left, right = np.flatnonzero(cut > 0), np.flatnonzero(cut < m - 2)
            a = np.concatenate([ids[cut[left] - 1, left], rank[right]])
            b = np.concatenate([rank[left], ids[cut[right] + 1, right]])
            found = self._ordered(self.made.find(self._key(a, b)))
            pair[cut[left] - 1, left], pair[cut[right], right] = found[: len(left)], found[len(left) :]


_cached: dict[tuple[str, str], Columns] = {}


def bpe(path: str, pattern: str) -> Columns:
    if (path, pattern) not in _cached:
        _cached[path, pattern] = Columns(load_ranks(path), pattern)
    return _cached[path, pattern]


class Permutation:
    """A keyed bijection of the numbers below n: Feistel rounds over the least even number of bits, walked until the result is below n."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        seed = hashlib.sha256(f"feistel:{key}".encode()).digest()
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(seed + bytes([i])).digest()[:8], "little")) for i in range(rounds)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys:
            left, right = right, left ^ (T.mix(right ^ k) & self.mask)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in reversed(self.keys):
            left, right = right ^ (T.mix(left ^ k) & self.mask), left
        return left << self.half | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, np.uint64))
        while (out := x >= np.uint64(self.n)).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._once)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self._back)


class Layout:
    def __init__(self, vocabulary: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS):
        # one id more than the vocabulary has: the end
        self.kind = np.dtype("<u2") if vocabulary < 65_536 else np.dtype("<u4")
        self.end, self.length, self.shard_slots = vocabulary, length, shard_slots
        fields = [("doc_id", "<i8"), ("seq", "<u4"), ("n", "<i4"), ("ids", self.kind, (length,))]
        self.head, self.body, self.record = np.dtype(fields[:-1]), np.dtype(fields), np.dtype([*fields, ("lf", "u1")])

    @property
    def stride(self) -> int:
        return self.record.itemsize

    def place(self, slot: int) -> tuple[int, int]:
        """(shard, byte offset) of a slot."""
        return slot // self.shard_slots, slot % self.shard_slots * self.stride


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of bytes, one after the other in data, as an Arrow column."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges(sizes).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def write(docs: DataFrame, path: str, pattern: str, out: str, key: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, Layout]:
    """Write the shards below out, in folders shard=0, shard=1, ...; gives the number of slots and the layout."""
    with small_batches(docs.sparkSession, BATCH):
        return _write(docs, path, pattern, out, key, length, shard_slots, id_col, text_col)


def _write(docs: DataFrame, path: str, pattern: str, out: str, key: int, length: int, shard_slots: int, id_col: str, text_col: str) -> tuple[int, Layout]:
    spark = docs.sparkSession
    ship(spark)
    layout = Layout(len(bpe(path, pattern).tokens), length, shard_slots)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's ids as bytes, the end after them, with the number of its first sequence in this task."""
        coder, at, part = bpe(path, pattern), 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo, size, ids, n in encoded(batch, coder):
                ends = np.cumsum(n)
                data = np.insert(ids.astype(layout.kind), ends, layout.end)
                begin = at + edges(-(-(n + 1) // length))
                at = int(begin[-1])
                raw = _binary(data, (n + 1) * layout.kind.itemsize)
                columns = [batch.column(0).slice(lo, size), pa.array(np.full(size, part)), pa.array(begin[:-1]), pa.array(np.diff(begin)), raw]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "n", "ids"])

    scratch = Scratch(spark, "sequences")
    done = scratch.save(rows.mapInArrow(T.tidy(number), "doc_id long, part long, at long, n long, ids binary"), "ids", compression="zstd")
    first, total, seen = {}, 0, []
    some = F.first(F.expr(f"substring(ids, 1, {SEEN * layout.kind.itemsize})")).alias("ids")
    for r in sorted(done.groupBy("part").agg(F.sum("n").alias("n"), some).collect()):
        first[r["part"]] = total
        total += r["n"]
        seen.append(np.frombuffer(r["ids"], layout.kind))
    if not total:
        scratch.drop()
        return 0, layout
    order = Permutation(total, key)
    # the ids by frequency in what was seen, for the packs: frequent ones take a byte
    of = np.argsort(-np.bincount(np.concatenate(seen), minlength=layout.end + 1), kind="stable").astype(layout.kind)
    numbers = np.empty_like(of)
    numbers[of] = np.arange(len(of))

    shards = -(-total // shard_slots)
    room = max(1, min(shard_slots, CELL_BYTES // layout.stride))  # slots of a cell
    cells = -(-shard_slots // room)  # of a shard

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs of records of one cell, without what fills them up."""
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for lo, hi in _ranges(sizes, PACK):
                some, pieces = batch.slice(lo, hi - lo), sizes[lo:hi]
                owner, begin = np.repeat(np.arange(hi - lo), pieces), edges(pieces)
                texts, ids = some.column(4), some.column(0)
                n = pa.compute.binary_length(texts).to_numpy().astype(np.int64) // layout.kind.itemsize
                head = np.zeros(int(begin[-1]), layout.head)
                seq = np.arange(len(head)) - begin[owner]
                head["seq"] = seq | np.where(ids.is_null().to_numpy(zero_copy_only=False), 1 << 31, 0)[owner]
                head["n"] = held = np.minimum(n[owner] - seq * length, length)
                head["doc_id"] = ids.fill_null(-1).to_numpy()[owner]
                first_id = edges(n)[owner] + seq * length
                number = some.column(2).to_numpy() + np.array([first[p] for p in some.column(1).to_pylist()], np.int64)
                slot = order.slots(number[owner] + seq)
                cell, place = slot // shard_slots * cells + slot % shard_slots // room, (slot % shard_slots % room).astype("<u4")
                by = np.argsort(cell, kind="stable")
                cell, place, head, held = cell[by], place[by], head[by], held[by]
                data = np.frombuffer(b"".join(texts.to_pylist()), layout.kind)[taken(first_id[by], held)]
                at, cuts = edges(held), np.flatnonzero(np.diff(cell, prepend=-1))
                packs = [_packed(place[i:j], head[i:j], data[at[i] : at[j]], numbers) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cell)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cell[cuts]), pa.array(np.diff(cuts, append=len(cell))), pa.array(packs, pa.binary())], ["cell", "n", "pack"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's records of full stride, by slot, but for the line feed that the writer adds. What is held is one cell."""
        now, waiting = -1, []

        def filled() -> Iterator[pa.RecordBatch]:
            place, head, ids = (np.concatenate(x) for x in zip(*(_unpacked(n, raw, layout, of) for n, raw in waiting), strict=True))
            by, at = np.argsort(place), edges(head["n"])
            for lo in range(0, len(by), RECORDS):
                some = by[lo : lo + RECORDS]
                out = np.empty(len(some), layout.body)
                for name in layout.head.names:
                    out[name] = head[name][some]
                held = out["n"].astype(np.int64)
                rows = np.full((len(some), length), layout.end, layout.kind)
                rows[np.arange(length) < held[:, None]] = ids[taken(at[some], held)]
                out["ids"] = rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now // cells, np.int32)), _binary(out.view(np.uint8), np.full(len(out), layout.body.itemsize))], ["shard", "value"])

        for batch in batches:
            for cell, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if cell != now and waiting:
                    yield from filled()
                    waiting.clear()
                now = cell
                waiting.append((n, raw))
        if waiting:
            yield from filled()

    packs = done.mapInArrow(T.tidy(cut), "cell long, n long, pack binary")
    packs = packs.repartitionById(shards, F.expr(f"cast(cell div {cells} as int)")).sortWithinPartitions("cell").mapInArrow(T.tidy(fill), "shard int, value binary")
    # the writer adds the line feed
    packs.select("shard", F.col("value").cast("string")).write.mode("overwrite").partitionBy("shard").text(out)
    scratch.drop()
    hand_back(spark)
    return total, layout


def _short(numbers: np.ndarray) -> np.ndarray:
    """Small numbers (below 2**28) in few bytes: seven bits in each from the highest on, all but a number's last with the top bit."""
    numbers = numbers.astype(np.int64)
    size = np.ones(len(numbers), np.int64)
    for k in (1, 2, 3):
        size += numbers >> 7 * k > 0
    end = np.cumsum(size) - 1
    out = np.empty(int(size.sum()), np.uint8)
    out[end] = numbers & 0x7F
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[end[more] - k] = numbers[more] >> 7 * k & 0x7F | 0x80
    return out


def _long(raw: np.ndarray) -> np.ndarray:
    """The numbers that _short wrote."""
    end = np.flatnonzero(raw < 0x80)
    size, out = np.diff(end, prepend=-1), raw[end].astype(np.int64)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= (raw[end[more] - k] & 0x7F).astype(np.int64) << 7 * k
    return out


def _packed(place: np.ndarray, head: np.ndarray, ids: np.ndarray, numbers: np.ndarray | None = None) -> bytes:
    """Records as the network holds them: places and heads, of each column all first bytes, then all second ones, and the ids (if given, their numbers
    instead) in few bytes, compressed; their length before compression leads."""
    raw = b"".join([np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in (place, head)])
    raw += _short(ids if numbers is None else numbers[ids]).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def _unpacked(n: int, pack: bytes, layout: Layout, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places, heads and ids of n packed records; of: the id of each number, if the ids were numbered."""
    size = int.from_bytes(pack[:8], "little")
    raw, at, out = np.frombuffer(pa.decompress(pack[8:], size, codec="zstd", asbytes=True), np.uint8), 0, []
    for kind in (np.dtype("<u4"), layout.head):
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    ids = _long(raw[at:])
    return *out, (ids if of is None else of[ids]).astype(layout.kind)


def _ranges(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum up to about that; a larger one stands alone."""
    held, lo = edges(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(held, held[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def index(spark, out: str, layout: Layout) -> DataFrame:
    """What the shards hold, read from their bytes: slot, shard, byte_offset, doc_id, seq, n_tokens, tokens_sha256 (of decimal ids joined by commas)."""
    ship(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = Spelling([b",%d" % i for i in range(layout.end + 1)])
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(raw) % layout.stride:
                    raise ValueError(f"shard {shard} has a broken record")
                r = np.frombuffer(raw, layout.record)
                n = r["n"].astype(np.int64)
                sha = decimal.digests(r["ids"][np.arange(layout.length) < n[:, None]], n, 1)
                at = np.arange(len(r), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + shard * layout.shard_slots), pa.array(np.full(len(r), shard, np.int32)), pa.array(at * layout.stride), pa.array(r["doc_id"], mask=r["seq"] >> 31 == 1), pa.array((r["seq"] & 0x7FFFFFFF).astype(np.int32)), pa.array(r["n"]), pa.array(sha, pa.string())],
                    ["slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens", "tokens_sha256"],
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(out)
    return files.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("int").alias("shard"), "content").mapInArrow(rows, "slot long, shard int, byte_offset long, doc_id long, seq int, n_tokens int, tokens_sha256 string")
