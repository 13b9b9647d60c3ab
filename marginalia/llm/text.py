"""Whole-text word arithmetic in numpy over batches of UTF-8 texts.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. These separators are ASCII, so runs of bytes are runs of code points.
Hashes are 64-bit polynomials over bytes, taken modulo 2**64 and then mixed.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
START = (np.arange(256) & 0xC0) != 0x80
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 2)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same pass over batches, which hands freed memory back to the system when its task ends: workers live on to run other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def join(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one buffer with a line feed before, between and after them; where each begins (one entry more than texts)."""
    texts = [t or b"" for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    begins = np.ones(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=begins[1:])
    begins[1:] += 1
    return buf, begins


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of a buffer that join made."""
    sep = SEPARATOR[buf]
    edges = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    return edges[0::2], edges[1::2]


def hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each of the ascending, disjoint spans; works through about CHUNK bytes at a time."""
    out = np.empty(len(begins), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(begins):
            low = int(begins[at])
            to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
            part = buf[low : int(ends[to - 1])]
            up, down = _power(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
            b, e = begins[at:to] - low, ends[at:to] - low
            out[at:to] = mix((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64))
            at = to
    return out


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words; len(h) - n + 1 of them, none if there are fewer words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * np.uint64(_BASE) + h[k : len(h) - n + 1 + k]
    return mix(out)


def chunks(texts: list[bytes | None], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about that many bytes; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def blobs(column) -> list[bytes | None]:
    """An Arrow string column as bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
