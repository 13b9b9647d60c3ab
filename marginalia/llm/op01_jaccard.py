"""N-gram Jaccard join by a count-vector R-tree.

A document's set holds its distinct word shingles. Two documents link when den * |A and B| >= num * |A or B|.

1. Points. Shingles are hashed into groups. The counts of the groups make a document's point; the overlap of two sets is at most
   the sum over coordinates of the smaller count. A point has about as many groups as its set has shingles (a power of two), which
   keeps the bound tight at every size; folding halves brings two points to the same groups. A count fills one byte; what goes beyond it
   is summed up in one more coordinate, so the bound holds.
2. Blocks, without cross joins and without loss. Two linked sets differ in at most k shingles, k following from the size band, so of
   k + 1 + e groups at least 1 + e hold exactly the same shingles in both. A document offers a signature for each of its groups that
   isn't empty; documents that share one are candidates. (A document with more than e empty groups also offers those, so the bound
   holds for it too.) A batch of documents reduces its own signatures first, so a group of copies that holds a third of all rows
   sends one record for each batch and signature; what crosses the network is packed records by bucket.
3. Each signature yields a star: its documents with the least among them. Stars whose bound allows it are verified on the full sets
   and give classes: a group of copies takes as many tests as it has members. The sets that share a signature are a block; blocks of the
   same sets are one. (What stars connect is no block: a line that many documents have connects most of a corpus by ever other signatures.)
4. The R-tree finds all other pairs of a block. A range partition by block, size and class, whose borders Spark fits on a bounded sample,
   deals every point of a block with three or more sets and more than one class to leaves of at most LEAF points, in one order, so a leaf
   holds neighbours and no block is in one task. A block that lies in one leaf is searched there, by a tree of its own. A leaf's box is
   the largest coordinates in it; nodes of FAN leaves or nodes have boxes too. The tree is joined with itself from the root down: pairs
   of nodes whose boxes allow a link are opened, all others left, so no pairs of leaves are listed beforehand. Pairs of leaves that are
   left are joined likewise, each leaf by a tree of its own, for pairs of different classes whose bound allows a link; nodes of one and
   the same class are left too. Survivors are verified on the full sets. Pairs inside a class need no test.

In steps 3 and 4 points, sets and leaves go to the pairs by an equi-join on the one side and lead the other side's rows once for each
task; a document that leads very many pairs is dealt over several tasks.

Defined results: null and empty texts have no shingles and link with nothing; a text with fewer words than a shingle has one, the
whole sequence; equal sets form one class by a 128-bit key and their size; repeated doc_id rows are one document's versions (the row with the
larger set counts); rows without doc_id have no component (null) and link with nothing, one row each; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import text as T
from marginalia.llm.graph import components, copied, dealt, hot_join, hot_keys
from marginalia.session import Scratch, hand_back, input_partitions, ship, small_batches

#: Groups of a point: the power of two from a set's size on, within these.
LEAST_GROUPS, MOST_GROUPS = 64, 1 << 16
#: Points of a leaf, their bytes, children of a node, and the groups of a box.
LEAF, LEAF_BYTES, FAN, BOX = 512, 2 << 20, 16, 512
#: Blocks of so many members have a second star.
MANY = 64
#: Rows in Python at once; batches also end at session.BATCH_BYTES.
BATCH = 2000
#: Ids that may be broadcast to filter the documents read again, and pairs that may be broadcast to their data: 8 bytes for each id; more go by shuffled joins.
BROADCAST_IDS = 500_000
_EMPTY = np.uint64(0x5851F42D4C957F2D)


def shingles(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 64-bit hash) of the distinct lower-cased word shingles, sorted by document and hash."""
    buf, at = T.join(texts)
    buf = T.LOWER[buf]
    begins, ends = T.spans(buf)
    doc = np.searchsorted(at, begins, "right") - 1
    h = T.hashes(buf, begins, ends)
    win = T.windows(h, width)
    whole = np.flatnonzero(doc[: len(win)] == doc[width - 1 :]) if len(win) else np.empty(0, np.int64)
    docs, keys = doc[whole], win[whole]
    n = np.bincount(doc, minlength=len(texts))
    for i in np.flatnonzero((n > 0) & (n < width)):
        low = int(np.searchsorted(doc, i))
        docs, keys = np.append(docs, i), np.append(keys, T.windows(h[low : low + n[i]], int(n[i])))
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    return docs[new], keys[new]


def point(keys: np.ndarray) -> bytes:
    """The counts of a set's groups, a byte each."""
    groups = min(max(LEAST_GROUPS, 1 << max(0, len(keys) - 1).bit_length()), MOST_GROUPS)
    counts = np.bincount((keys >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def planes(raw: bytes) -> bytes:
    """A point as tables and the network hold it: its bit planes, most of which are none, and their number; as it is where all eight are needed."""
    p = np.frombuffer(raw, np.uint8)
    k = max(1, int(p.max()).bit_length())
    return raw if k == 8 else np.packbits(p >> np.arange(k, dtype=np.uint8)[:, None] & 1).tobytes() + bytes([k])


def counts(raw: bytes) -> bytes:
    """The point of its planes, whose length is odd."""
    if len(raw) % 2 == 0:
        return raw
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, len(raw) - 1)).reshape(raw[-1], -1)
    return np.bitwise_or.reduce(bits << np.arange(raw[-1], dtype=np.uint8)[:, None]).tobytes()


def folded(raw: bytes, n: int, groups: int) -> np.ndarray:
    """The point of a set of n shingles with so many groups, at most its own number, and after them what its bytes couldn't count."""
    p = np.frombuffer(raw, np.uint8)
    out = np.empty(groups + 1, np.uint32)
    out[:groups] = p if len(p) == groups else p.reshape(-1, groups).sum(0, dtype=np.uint32)
    out[groups] = n - int(out[:groups].sum())
    return out


def _falls_short(n: int, groups: int, k: int) -> bool:
    """Whether it isn't rare (1 in 10,000; by four standard deviations for large sets) that n shingles fill at most k groups."""
    if n > 256:
        share = math.exp(-n / groups)
        return groups * (1 - share) - 4 * math.sqrt(groups * share * (1 - (1 + n / groups) * share)) <= k
    filled, at = np.zeros(groups + 1), np.arange(groups + 1)
    filled[0] = 1.0
    for _ in range(n):
        filled[1:] = filled[1:] * at[1:] / groups + filled[:-1] * (groups - at[:-1]) / groups
        filled[0] = 0.0
    return filled[: k + 1].sum() > 1e-4


def _spare(n: int, k: int) -> int:
    """So many groups more than k + 1 that sets of n shingles hardly ever leave more than that empty: empty groups are alike in unlike documents."""
    least = most = k // 20 + 3
    if k >= n:  # nothing helps: the bands are wide at a low similarity
        return most
    while most < 8 * n and _falls_short(n, k + 1 + most, k):
        least, most = most, 2 * most
    while least < most:
        e = (least + most) // 2
        least, most = (e + 1, most) if _falls_short(n, k + 1 + e, k) else (least, e)
    return most


class Bands:
    """Size bands [low, next low), and for each how many groups its signatures have."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low, ratio = [1], max(1.5, den / num)
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(np.ceil(low[-1] * ratio))))
        self.low = np.array(low, np.int64)
        # the shingles in which two linked sets can differ, the smaller of which is in the band
        self.differ = (self.low[1:] - 1) * (den - num) // num
        self.spare = np.array([_spare(n, k) if k else 0 for n, k in zip(low, self.differ.tolist(), strict=False)], np.int64)
        self.groups = self.differ + 1 + self.spare

    def roles(self, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, band): each in its own band, and in the band below if a set there can link with it."""
        own = np.searchsorted(self.low, n, "right") - 1
        some = n > 0
        upper = some & (own > 0)
        upper[upper] = n[upper] * self.num <= self.den * (self.low[own[upper]] - 1)
        return [(np.flatnonzero(some), own[some]), (np.flatnonzero(upper), own[upper] - 1)]


def signatures(docs: np.ndarray, keys: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(document index, signature) for the groups of each document in each of its bands."""
    out_doc, out_sig = [], []
    begin = np.concatenate([[0], np.cumsum(n)])
    with np.errstate(over="ignore"):
        spread = T.mix(keys ^ np.uint64(0xA0761D6478BD642F))
        for members, band in bands.roles(n):
            if not len(members):
                continue
            groups = bands.groups[band]
            base = np.concatenate([[0], np.cumsum(groups)])  # a cell for each group of each member
            size = n[members]
            index = np.repeat(np.arange(len(members)), size)
            row = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.repeat(begin[members], size)
            k = keys[row]
            cell = base[index] + (k % groups[index].astype(np.uint64)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            c = cell[order]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread[row][order])])
            held = np.searchsorted(c, np.arange(base[-1] + 1))
            sums = total[held[1:]] - total[held[:-1]]
            full = held[1:] > held[:-1]
            owner = np.repeat(np.arange(len(members)), groups)
            empties = np.bincount(owner[~full], minlength=len(members))
            offered = full | (empties[owner] > bands.spare[band][owner])
            sums[~full] = _EMPTY
            slot = np.arange(base[-1]) - base[owner]
            sig = T.mix(sums + T.mix((band[owner] << 40).astype(np.uint64) + slot.astype(np.uint64) + np.uint64(1)))
            out_doc.append(members[owner[offered]])
            out_sig.append(sig[offered])
    if not out_doc:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(out_doc), np.concatenate(out_sig)


def _stars(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, least id of each), and the links of the others with the least, each with its signature."""
    order = np.lexsort((ids, sig))
    s, d = sig[order], ids[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    lead = d[new][np.cumsum(new) - 1] if len(s) else d
    other = np.flatnonzero(d != lead)
    return s[new], d[new], s[other], lead[other], d[other]


def _links(sig: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Rows for links, not too many at once."""
    for i in range(0, len(a), most):
        yield _batch(LINK, len(a[i : i + most]), bucket=b[i : i + most], a=a[i : i + most], b=b[i : i + most], hi=sig[i : i + most].view(np.int64))


_MAPPED = pa.schema([("bucket", pa.int64()), ("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("data", pa.binary())])
_MAPPED_DDL = "bucket long, kind tinyint, a long, b long, n long, hi long, lo long, data binary"
DOC, LINK, RECORDS = 0, 1, 2
RECORD = np.dtype([("s", "<u8"), ("d", "<i8")])


def _batch(kind: int, size: int, **columns) -> pa.RecordBatch:
    cols = {"kind": np.full(size, kind, np.int8)} | columns
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in _MAPPED], schema=_MAPPED)


def _mapped(batches: Iterator[pa.RecordBatch], width: int, bands: Bands, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for documents; links within a batch, with their signatures; packed (signature, least id) records by bucket."""
    for batch in batches:
        named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy()
        texts = T.blobs(batch.column(1))
        sigs, owners = [], []
        for i, j in T.chunks(texts, T.CHUNK // 2):
            docs, keys = shingles(texts[i:j], width)
            m = j - i
            n = np.bincount(docs, minlength=m).astype(np.int64)
            with np.errstate(over="ignore"):
                begin = np.concatenate([[0], np.cumsum(n)])
                hi = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(keys))])
                lo = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(keys ^ np.uint64(0xE7037ED1A0B428DB)))])
                hi, lo = T.mix(hi[begin[1:]] - hi[begin[:-1]]), T.mix(lo[begin[1:]] - lo[begin[:-1]])
            points = [planes(point(keys[begin[k] : begin[k + 1]])) for k in range(m)]
            own = ids[i:j]
            shown = pa.array(own, mask=~named[i:j])
            yield _batch(DOC, m, bucket=own % buckets, a=shown, n=n, hi=hi.view(np.int64), lo=lo.view(np.int64), data=points)
            # of equal sets in the chunk, one offers signatures; classes of equal sets come from hi and lo
            key = np.stack([hi, lo, n.astype(np.uint64)], 1)
            order = np.argsort(own, kind="stable")
            order = order[named[i:j][order]]
            one = order[np.unique(key[order], axis=0, return_index=True)[1]]
            picked = np.zeros(m, bool)
            picked[one] = True
            sel = picked[docs]
            d, s = signatures(docs[sel], keys[sel], np.where(picked, n, 0), bands)
            sigs.append(s)
            owners.append(own[d])
        if not sigs:
            continue
        s, d, *found = _stars(np.concatenate(sigs), np.concatenate(owners))
        yield from _links(*found)
        bucket = (s % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((d, bucket))
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        parts = [_packed(s[at], d[at]) for at in np.split(order, cuts[1:])] if len(s) else []
        if parts:
            yield _batch(RECORDS, len(parts), bucket=bucket[order][cuts], data=parts)


def _packed(sig: np.ndarray, ids: np.ndarray) -> bytes:
    """Records: the signatures, then the ids, whose first bytes come first, whose second bytes come next, and so on: like bytes lie together and compress."""
    return sig.astype("<u8").tobytes() + ids.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 16
    out = np.empty(n, RECORD)
    out["s"] = np.frombuffer(raw, "<u8", n)
    out["d"] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 * n).reshape(8, n).T).view("<i8").ravel()
    return out


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and links pass; the records of a bucket become links. What is held is one record for a signature."""
    held, waiting, size = np.empty(0, RECORD), [], 0

    def reduce() -> tuple[np.ndarray, Iterator[pa.RecordBatch]]:
        every = np.concatenate([held, *map(_unpacked, waiting)])
        s, d, *found = _stars(every["s"], every["d"])
        out = np.empty(len(s), RECORD)
        out["s"], out["d"] = s, d
        return out, _links(*found)

    for batch in batches:
        records = pa.compute.equal(batch.column(1), pa.scalar(RECORDS, pa.int8()))
        rest = batch.filter(pa.compute.invert(records))
        if rest.num_rows:
            yield rest
        for x in batch.column(7).filter(records).to_pylist():
            waiting.append(x)
            size += len(x)
        if size > max(16 << 20, held.nbytes):
            held, links = reduce()
            waiting, size = [], 0
            yield from links
    if waiting:
        yield from reduce()[1]


class RTree:
    """Count vectors packed by class and size; an inner node keeps the largest coordinates below it, and the range of sizes and of classes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, klass: np.ndarray, fan: int = 16):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes, klass))
        p, n, k = points[self.order], sizes[self.order], klass[self.order]
        self.fan, self.levels = fan, [(p, n, n, k, k)]
        while len(self.levels[-1][1]) > 1:
            p, low, high, least, most = self.levels[-1]
            cut = np.arange(0, len(low), fan)
            least_of, most_of = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((most_of(p, cut, 0), least_of(low, cut), most_of(high, cut), least_of(least, cut), most_of(most, cut)))

    def join(self, other: RTree, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the points of this tree and of the other whose classes differ and whose overlap can reach the similarity; within one tree each pair once."""
        i = j = np.zeros(1, np.int64)
        for depth in range(max(len(self.levels), len(other.levels)) - 1, -1, -1):
            x, y = (t.levels[min(depth, len(t.levels) - 1)] for t in (self, other))
            if other is self:
                i, j = i[i <= j], j[i <= j]
            i, j = _meeting(x, i, y, j, num, den)
            if depth:
                i, j = (t._opened(k, depth, flat) for t, k, flat in ((self, i[:, None, None], (1, -1, 1)), (other, j[:, None, None], (1, 1, -1))))
                i, j = (k.ravel() for k in np.broadcast_arrays(i, j))
                real = (i < len(self.levels[min(depth, len(self.levels)) - 1][1])) & (j < len(other.levels[min(depth, len(other.levels)) - 1][1]))
                i, j = i[real], j[real]
        return self.order[i], other.order[j]

    def _opened(self, nodes: np.ndarray, depth: int, flat: tuple[int, ...]) -> np.ndarray:
        """The children of nodes of this depth; a tree that is less high stays at its root."""
        return nodes * self.fan + np.arange(self.fan).reshape(flat) if depth < len(self.levels) else nodes


#: Coordinates that are compared at once.
COMPARED = 1 << 18


def _meeting(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of nodes i of x and j of y that can hold a link between classes."""
    (p, low, high, least, most), (q, low_y, high_y, least_y, most_y) = x, y
    keep = (low[i] * num <= high_y[j] * den) & (low_y[j] * num <= high[i] * den)
    keep &= (least[i] != most[i]) | (least_y[j] != most_y[j]) | (least[i] != least_y[j])
    i, j = i[keep], j[keep]
    keep = np.zeros(len(i), bool)
    step = max(1, COMPARED // p.shape[1])
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        bound = np.minimum(np.minimum(p[a], q[b]).sum(1, dtype=np.int64), np.minimum(high[a], high_y[b]))
        # den * overlap >= num * (size + other - overlap), the sizes as small as the nodes allow
        keep[at : at + step] = (den + num) * bound >= num * (low[a] + low_y[b])
    return i[keep], j[keep]


# ---- leaves and boxes -----------------------------------------------------------------------------------------------------------------


class Leaf:
    """Points of one block: ids, sizes, classes and the packed points."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, klass: np.ndarray, points: list[bytes]):
        self.ids, self.n, self.klass, self.points = ids, n, klass, points
        self.groups = min(map(len, points))
        self._trees: dict[int, RTree] = {}

    def pack(self) -> bytes:
        parts = (np.array([len(self.ids)]), self.ids, self.n, self.klass, np.array([len(p) for p in self.points]))
        return b"".join([np.concatenate(parts).astype(np.int64).tobytes(), *self.points])

    @staticmethod
    def unpack(raw: bytes) -> Leaf:
        k = int(np.frombuffer(raw, np.int64, 1)[0])
        ids, n, klass, size = np.frombuffer(raw, np.int64, 4 * k, 8).reshape(4, k)
        ends = 8 + 32 * k + np.cumsum(size)
        return Leaf(ids, n, klass, [raw[b - a : b] for a, b in zip(size.tolist(), ends.tolist(), strict=True)])

    def folded(self, groups: int) -> np.ndarray:
        out, sizes = np.empty((len(self.ids), groups + 1), np.uint32), np.array([len(p) for p in self.points])
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            p = np.frombuffer(b"".join([self.points[k] for k in at.tolist()]), np.uint8)
            out[at, :groups] = p.reshape(len(at), -1, groups).sum(1, dtype=np.uint32)
        out[:, groups] = self.n - out[:, :groups].sum(1, dtype=np.int64)
        return out

    def tree(self, groups: int) -> RTree:
        """The tree over the points with so many groups, built once."""
        if groups not in self._trees:
            self._trees[groups] = RTree(self.folded(groups), self.n, self.klass)
        return self._trees[groups]

    def pairs(self, num: int, den: int, other: Leaf | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(smaller id, larger id): pairs of its points, or of a point of its own with one of the other's, of different classes, whose bound allows a link."""
        groups = min(self.groups, (other or self).groups)
        tree = self.tree(groups)
        i, j = tree.join(other.tree(groups) if other else tree, num, den)
        i, j = self.ids[i], (other or self).ids[j]
        return np.minimum(i, j), np.maximum(i, j)

    def box(self) -> bytes:
        return self.folded(min(self.groups, BOX)).max(0).tobytes()


def _narrow(box: np.ndarray, groups: int) -> np.ndarray:
    """A box with fewer groups: sums of largest coordinates bound the sums' largest."""
    return np.append(box[:-1].reshape(-1, groups).sum(0, dtype=np.uint32), box[-1]) if len(box) > groups + 1 else box


def _over(boxes: list[bytes]) -> bytes:
    """The box around boxes."""
    every = [np.frombuffer(b, np.uint32) for b in boxes]
    groups = min(map(len, every)) - 1
    return np.max([_narrow(b, groups) for b in every], axis=0).tobytes()


_NODE = "block long, i long, low long, high long, least long, most long, box binary"


_LEAVES = "part long, at long, block long, low long, high long, least long, most long, box binary, body binary, a long, b long"


def _leaves(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (block, klass, id, n, data) as leaves: part, at (their order), block, least and greatest size and class, points, box, body.

    A block that lies whole in one leaf is searched here and leaves its pairs (a, b) alone. The first and the last block of a task may go on elsewhere."""
    names = [f.split()[0] for f in _LEAVES.split(", ")]
    part, at, held, size, first, whole, pairs = TaskContext.get().partitionId(), 0, [], 0, True, True, []

    def made() -> Leaf:
        _, klass, ids, n, points = zip(*held, strict=True)
        return Leaf(np.array(ids), np.array(n), np.array(klass), list(points))

    def leaf() -> pa.RecordBatch:
        x = made()
        values = [part, at, held[0][0], x.n.min(), x.n.max(), x.klass.min(), x.klass.max(), x.box(), x.pack()]
        return pa.RecordBatch.from_arrays([*(pa.array([v]) for v in values), *([pa.nulls(1, pa.int64())] * 2)], names)

    def found() -> pa.RecordBatch:
        some = [np.concatenate(x) for x in zip(*pairs, strict=True)]
        n = len(some[0])
        return pa.RecordBatch.from_arrays([*([pa.nulls(n, pa.int64())] * 7), *([pa.nulls(n, pa.binary())] * 2), *map(pa.array, some)], names)

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), map(counts, batch.column(4).to_pylist()), strict=True):
            if held and (held[0][0] != row[0] or len(held) == LEAF or size > LEAF_BYTES):
                ended = held[0][0] != row[0]
                if ended and whole and not first:
                    pairs.append(made().pairs(num, den))
                else:
                    yield leaf()
                    at += 1
                first, whole, held, size = first and not ended, ended, [], 0
            held.append(row)
            size += len(row[4])
        if sum(len(a) for a, _ in pairs) > 1 << 16:
            yield found()
            pairs = []
    if pairs:
        yield found()
    if held:
        yield leaf()


def _touching(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The rows (block, i, j, least size of i, of j, boxes) where a point of the one node can link with one of the other."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            groups = min(len(x), len(y)) - 1
            keep.append((den + num) * int(np.minimum(_narrow(x, groups), _narrow(y, groups)).sum(dtype=np.int64)) >= num * (n + m))
        yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))


def _leaf_pairs(leaves: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of leaves of one block, a leaf with itself included, that can hold a link between classes. leaves has an id."""
    alone = leaves.groupBy("block").agg(F.count("*").alias("c"))
    before = leaves.groupBy("block", "part").agg(F.count("*").alias("c"))  # a row for each task that has part of the block
    before = before.select("block", "part", (F.sum("c").over(Window.partitionBy("block").orderBy("part")) - F.col("c")).alias("before"))
    first = leaves.groupBy("block", "part").agg(F.min("at").alias("first"))
    nodes = leaves.join(alone.where("c > 1").select("block"), "block", "left_semi").join(before, ["block", "part"]).join(first, ["block", "part"])
    nodes = nodes.select("block", (F.col("before") + F.col("at") - F.col("first")).alias("i"), "low", "high", "least", "most", "box", "id")
    bottom = scratch.save(nodes, "nodes-0")
    levels = [bottom.drop("id")]
    while (levels[-1].agg(F.max("i")).first()[0] or 0) > 0:
        up = levels[-1].groupBy("block", F.shiftright("i", int(math.log2(FAN))).alias("i"))
        up = up.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list("box").alias("boxes"))

        def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([_over(b) for b in batch.columns[-1].to_pylist()], pa.binary())], [*batch.schema.names[:-1], "box"])

        levels.append(scratch.save(up.mapInArrow(around, _NODE), f"nodes-{len(levels)}"))
    pairs = levels[-1].select("block", "i", F.col("i").alias("j"))
    for depth in range(len(levels) - 2, -1, -1):
        kids = lambda x: F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda k: F.col(x) * FAN + k)
        opened = pairs.select("block", F.explode(kids("i")).alias("i"), "j").select("block", "i", F.explode(kids("j")).alias("j")).where("i <= j")
        side = lambda k, x: levels[depth].select("block", F.col("i").alias(k), *(F.col(c).alias(c + x) for c in ("low", "high", "least", "most", "box")))  # noqa: E731, B023
        met = opened.join(side("i", "_x"), ["block", "i"]).join(side("j", "_y"), ["block", "j"])
        met = met.where((F.col("low_x") * num <= F.col("high_y") * den) & (F.col("low_y") * num <= F.col("high_x") * den))
        met = met.where("least_x != most_x OR least_y != most_y OR least_x != least_y")  # all of one class needs no test
        met = met.select("block", "i", "j", "low_x", "low_y", "box_x", "box_y").mapInArrow(lambda it: _touching(it, num, den), "block long, i long, j long")
        pairs = scratch.save(met, f"pairs-{depth}")
    name = lambda k, a: bottom.select("block", F.col("i").alias(k), F.col("id").alias(a))
    within = leaves.join(alone.where("c = 1").select("block"), "block", "left_semi").where("least != most").select(F.col("id").alias("a"), F.col("id").alias("b"))
    return pairs.join(name("i", "a"), ["block", "i"]).join(name("j", "b"), ["block", "j"]).select("a", "b").union(within)


# ---- tests of pairs -------------------------------------------------------------------------------------------------------------------


def _tested(pairs: DataFrame, data: DataFrame, read: Callable, test: Callable, parts: int) -> DataFrame:
    """The pairs (a, b) that `test` gives for the pairs (a, b) of a saved table, whose ids data (id, n, data) explains.

    b's data go to the pairs by a join, where few pairs are sent to all data instead, so that data cross the network once, with their pairs;
    a's data lead the rows of a once in each task. Hot ids are dealt over several tasks."""
    few = pairs.count() <= BROADCAST_IDS
    hot = hot_keys(pairs.select("a"), ["a"])
    right, bodies = dealt(pairs.select("a", "b"), ["a"], hot, "_turn"), data.withColumnRenamed("id", "b")
    right = bodies.join(F.broadcast(right), "b") if few else hot_join(right, bodies, ["b"], hot=hot_keys(pairs.select("b"), ["b"]))
    right = right.select("a", F.col("_turn").alias("_salt"), "b", "n", "data")
    leads = pairs.select(F.col("a").alias("id")).distinct()
    left = copied(data.join(F.broadcast(leads) if few else leads, "id", "left_semi").withColumnRenamed("id", "a"), ["a"], hot)
    left = left.select("a", "_salt", F.lit(None).cast("long").alias("b"), "n", "data")
    rows = left.union(right).repartition(parts, "a", "_salt").sortWithinPartitions("a", "_salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, b, n, raw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if b is None:
                    lead = read(n, raw)
                else:
                    out += test(a, lead, b, read(n, raw))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(T.tidy(run), "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, n, data): the sets of the documents with these ids, from their whole texts, as sorted hashes."""
    few = ids.count() <= BROADCAST_IDS  # 8 bytes each, so at most 4 MB
    some = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = T.blobs(batch.column(1))
            for i, j in T.chunks(texts, T.CHUNK // 2):
                owner, keys = shingles(texts[i:j], width)
                cuts = np.searchsorted(owner, np.arange(j - i + 1))
                raw = keys.tobytes()
                packed = [raw[8 * a : 8 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(cuts)), pa.array(packed, pa.binary())], ["id", "n", "data"])

    return some.mapInArrow(T.tidy(build), "id long, n long, data binary")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int, parts: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that link, by their full sets."""
    pairs = scratch.save(pairs, f"{name}-pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    ids = scratch.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), f"{name}-ids")
    sets = scratch.save(_sets(docs, ids, width).groupBy("id").agg(F.max(F.struct("n", "data")).alias("x")).select("id", "x.*"), f"{name}-sets")

    def same(a: int, x: np.ndarray, b: int, y: np.ndarray) -> list[tuple[int, int]]:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return [(a, b)] if den * both >= num * (len(x) + len(y) - both) else []

    out = scratch.save(_tested(pairs, sets, lambda n, raw: np.frombuffer(raw, np.uint64), same, parts), f"{name}-links")
    for x in ("pairs", "sets", "ids"):
        scratch.drop(f"{name}-{x}")
    return out


def join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the least doc_id that links reach, itself included)."""
    with small_batches(docs.sparkSession, BATCH):
        return _join(docs, width, num, den, id_col, text_col)


def _join(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    scratch, bands = Scratch(spark, "jaccard"), Bands(num, den)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    parts = input_partitions(docs, 16 << 20)
    buckets = 8 * parts
    mapped = docs.mapInArrow(T.tidy(lambda it: _mapped(it, width, bands, buckets)), _MAPPED_DDL)
    base = scratch.save(mapped.repartition(parts, "bucket").mapInArrow(T.tidy(_reduced), _MAPPED_DDL), "base")
    info = base.where((F.col("kind") == DOC) & F.col("a").isNotNull()).select(F.col("a").alias("id"), "n", "hi", "lo", "data")
    twice = scratch.save(info.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "twice")
    if twice.limit(1).count():
        one = info.join(twice, "id", "left_semi").groupBy("id").agg(F.max(F.struct("n", "hi", "lo", "data")).alias("x")).select("id", "x.*")
        info = scratch.save(info.join(twice, "id", "left_anti").union(one), "info")
    # classes of equal sets
    known = info.where("n > 0").select("id", "n", "hi", "lo")
    first = known.groupBy("n", "hi", "lo").agg(F.min("id").alias("rep"))
    rep = scratch.save(hot_join(known, first, ["n", "hi", "lo"]).select("id", "rep", "n"), "rep")
    # candidates between classes: all, which make the blocks, and those whose sizes allow a link
    star = scratch.save(base.where(F.col("kind") == LINK).select("a", "b").distinct(), "raw")
    named = lambda k, m: rep.select(F.col("id").alias(k), F.col("rep").alias("r" + k), F.col("n").alias(m))
    link = hot_join(star, named("a", "n"), ["a"]).join(named("b", "m"), "b").where("ra != rb")
    less = F.col("ra") < F.col("rb")
    link = link.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), F.when(less, F.col("n")).otherwise(F.col("m")).alias("n"), F.when(less, F.col("m")).otherwise(F.col("n")).alias("m"))
    link = scratch.save(link.distinct(), "candidates")
    star = link.where((F.col("n") * num <= F.col("m") * den) & (F.col("m") * num <= F.col("n") * den))
    points = scratch.save(info.join(rep.where("id = rep").select("id"), "id", "left_semi").select("id", "n", "data"), "points")

    def bound(a: int, x: tuple[int, bytes], b: int, y: tuple[int, bytes]) -> list[tuple[int, int]]:
        groups = min(len(x[1]), len(y[1]))
        least = int(np.minimum(folded(x[1], x[0], groups), folded(y[1], y[0], groups)).sum(dtype=np.int64))
        return [(a, b)] if (den + num) * least >= num * (x[0] + y[0]) else []

    links = _verified(_tested(star, points, lambda n, raw: (n, counts(raw)), bound, parts), docs, width, num, den, parts, scratch, "star")
    klass = components(links, scratch, "class")
    # blocks: the sets of a signature, where they are three or more (of two, the star is the pair)
    by_block = base.where(F.col("kind") == LINK).select(F.col("hi").alias("block"), "a", "b").repartition(parts, "block")
    several = by_block.groupBy("block").agg(F.count("*").alias("c")).where("c > 1").select("block")
    signed = by_block.join(several, "block", "left_semi").select("block", F.explode(F.array("a", "b")).alias("id"))
    member = scratch.save(signed.join(rep.select("id", "rep"), "id").select("block", F.col("rep").alias("id")).distinct(), "members")
    mixed = scratch.save(_mixed(member, klass), "mixed")
    # a star more for large blocks, each with a document of its own in the middle: near copies whose least is far from many of them are one class then
    middle = mixed.where(F.col("c") >= MANY).groupBy("block").agg(F.min_by(F.struct("id", "klass"), F.xxhash64("block", "id")).alias("x"))
    again = hot_join(mixed, middle, ["block"]).where("klass != x.klass").select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b")).distinct()
    again = scratch.save(again.join(link, ["a", "b"], "left_anti"), "again")
    if not again.isEmpty():
        more = _verified(_tested(again, points, lambda n, raw: (n, counts(raw)), bound, parts), docs, width, num, den, parts, scratch, "more-star")
        link, links = link.select("a", "b").union(again), links.union(more)
        klass = components(links, scratch, "class-again")
        mixed = scratch.save(_mixed(member, klass), "mixed-again")
    rows = mixed.select("first", "block", "id", "klass").join(points, "id").withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num + 1e-9))).cast("long"))
    rows = scratch.save(rows, "rows")
    final = klass if rows.isEmpty() else components(links.union(_across(rows, link, docs, width, num, den, parts, scratch)), scratch, "final")
    out = scratch.save(info.select("id", "n").join(rep.select("id", "rep"), "id", "left"), "reps")
    out = hot_join(out, final.select(F.col("id").alias("rep"), "component"), ["rep"], "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
    nameless = base.where((F.col("kind") == DOC) & F.col("a").isNull()).select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    out = scratch.keep(out.union(nameless), "result")
    hand_back(spark)
    return out


def _mixed(member: DataFrame, klass: DataFrame) -> DataFrame:
    """(block, id, klass, c, first): the c members, first the least, of each block with three or more, in more than one class; one block of those with the same members."""
    named = member.join(klass, "id", "left").select("block", "id", F.coalesce("component", "id").alias("klass"))
    split = named.groupBy("block").agg(F.count("*").alias("c"), F.min("id").alias("first"), F.min("klass").alias("low"), F.max("klass").alias("high"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y"))
    split = split.where("low != high AND c > 2").groupBy("c", "first", "x", "y").agg(F.min("block").alias("block")).select("block", "c", "first")
    return named.join(split, "block")


def _across(rows: DataFrame, link: DataFrame, docs: DataFrame, width: int, num: int, den: int, parts: int, scratch: Scratch) -> DataFrame:
    """The links (a, b) between classes of one block that no star tested. rows: block, klass, id, n, data, size, and first where it is known.

    Blocks of one first member share most of their members: they go to one task or to neighbours, so what a shuffle writes for a member of them compresses."""
    order = [c for c in ("first", "block", "size", "klass", "id") if c in rows.columns]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = rows.select("block", "klass", "id", "n", "data").mapInArrow(T.tidy(lambda it: _leaves(it, num, den)), _LEAVES)
    made = scratch.save(packed.withColumn("id", F.shiftleft("part", 40) + F.col("at")), "leaves")
    leaves, inside = made.where("a IS NULL").drop("a", "b"), made.where("a IS NOT NULL").select("a", "b")
    met = scratch.save(_leaf_pairs(leaves.drop("body"), num, den, scratch), "met")

    def search(a: int, x: Leaf, b: int, y: Leaf) -> list[tuple[int, int]]:
        i, j = x.pairs(num, den, None if a == b else y)
        return list(zip(i.tolist(), j.tolist(), strict=True))

    bodies = leaves.select("id", F.lit(0).cast("long").alias("n"), F.col("body").alias("data"))
    with small_batches(docs.sparkSession, 16):  # leaves are large
        more = scratch.save(_tested(met, bodies, lambda n, raw: Leaf.unpack(raw), search, 4 * parts), "more")
    return _verified(more.union(inside).distinct().join(link, ["a", "b"], "left_anti"), docs, width, num, den, parts, scratch, "rest")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stand for their group: those whose doc_id is its least. Rows without a doc_id stay."""
    found = join(docs, width, num, den).where("component_id != doc_id").select("doc_id")
    few = found.count() <= BROADCAST_IDS  # then no text crosses the network
    return docs.join(F.broadcast(found) if few else found, "doc_id", "left_anti").select(*docs.columns)


#: The whole result of op1 in DuckDB SQL.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(ws[i : i + 3]) AS sh, ws[i : i + 3] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.g = b.g AND a.doc_id != b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
