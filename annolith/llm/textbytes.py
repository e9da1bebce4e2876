"""Words of many texts as NumPy arrays: places, 64-bit hashes and n-gram combinations, without a Python object per word."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE, BASE_INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at once; the power tables have this length.
CHUNK = 1 << 18

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverses modulo 2**64 for k below n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 64)
        _powers[:] = []
        with np.errstate(over="ignore"):
            for b in (BASE, BASE_INVERSE):
                p = np.full(size, b, U)
                p[0] = 1
                _powers.append(np.cumprod(p))
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Words:
    """The words of a buffer in which words are parted by single bytes below 0x21: start and end places, and hashes."""

    def __init__(self, buffer: bytes):
        self.buffer = buffer
        raw = np.frombuffer(buffer, np.uint8)
        word = (raw != 0x20) & (raw != 0x0A)
        edge = np.diff(word.view(np.int8), prepend=0, append=0)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.hash = self._hashes(raw, word)

    def _hashes(self, raw: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Polynomial hashes, mixed; chunks end at word ends."""
        out, first, n = np.empty(len(self.start), U), 0, len(self.start)
        with np.errstate(over="ignore"):
            while first < n:
                origin = int(self.start[first])
                last = max(first + 1, int(np.searchsorted(self.end, origin + CHUNK, "right")))
                stop = int(self.end[last - 1])
                power, inverse = powers(stop - origin)
                value = np.where(word[origin:stop], raw[origin:stop].astype(U) + U(1), U(0)) * power[: stop - origin]
                at = self.start[first:last] - origin
                out[first:last] = np.add.reduceat(value, at) * inverse[at]
                first = last
        return mixed(out ^ (self.end - self.start).astype(U))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.empty(0, U)
    out = np.zeros(len(h) - n + 1, U)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * BASE + h[k : len(h) - n + 1 + k]
    return mixed(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of n consecutive values from each place on."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def trim() -> None:
    """Hands freed memory back to the system: workers live on between tasks, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def flushes(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.Table]:
    """The rows in tables of about `most` bytes of text; one text may be more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        begin = 0
        total = np.cumsum(lengths)
        while begin < batch.num_rows:
            base = int(total[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + most - size, "right")))
            held.append(batch.slice(begin, end - begin))
            size += int(total[end - 1]) - base
            begin = end
            if size >= most or begin < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                trim()
    if held:
        yield pa.Table.from_batches(held)
    trim()
