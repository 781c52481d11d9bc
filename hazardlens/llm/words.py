"""Words of whole texts as hashes, for work on Arrow batches inside tasks.

Texts are taken as UTF-8 bytes. A word is a run of bytes that a table of 256 flags accepts; both tables
below only tell ASCII characters apart, so byte runs and code point runs are the same. Every word gets a
64-bit hash of its bytes; hashes are equal in every task and run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at a time; a longer single text forms a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes whose words are hashed at a time; bounds the eight-byte temporaries of a very long text.
HASH_BYTES = 4 << 20

_codes = np.arange(256)
#: `[^\x20\x09-\x0D]`
NOT_SPACE = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`
ALPHANUMERIC = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)
_LOWER = np.where((_codes >= 0x41) & (_codes <= 0x5A), _codes + 32, _codes).astype(np.uint8)

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (values + _STEP).astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def salt(number: int) -> np.uint64:
    return mix(np.array([number % (1 << 64)], np.uint64))[0]


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, length: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < length:
        size = max(length, 1 << 16)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if size <= 2 * HASH_BYTES:
            _powers[base] = table
    return table


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per span: differences of running sums of byte values times powers, in 64-bit arithmetic."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    inverse = pow(_BASE, -1, 1 << 64)
    while done < len(starts):
        first = starts[done]
        upto = max(int(np.searchsorted(ends, first + HASH_BYTES, "right")), done + 1)
        last = ends[upto - 1]
        size = int(last - first)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data[first:last]] * _power_table(_BASE, size)[:size], out=sums[1:])
        at = (starts[done:upto] - first).astype(np.int64)
        to = (ends[done:upto] - first).astype(np.int64)
        out[done:upto] = (sums[to] - sums[at]) * _power_table(inverse, size)[at]
        out[done:upto] += (to - at).astype(np.uint64) * _STEP
        done = upto
    return mix(out)


@dataclass
class Words:
    """Words of some texts. Word i covers ``data[starts[i]:ends[i]]``; text j has words ``bounds[j]`` to ``bounds[j+1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all runs of ``size`` words inside one text, in order."""
        total = len(self.hashes) - size + 1
        if total <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        owner = self.owner
        at = np.flatnonzero(owner[:total] == owner[size - 1:])
        return at, gram_hash(self.hashes, at, size)


def gram_hash(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = mix(hashes[at] + salt(size))
    for k in range(1, size):
        out = mix(out * _STEP + hashes[at + k])
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    store = column.buffers()[2]
    data = np.frombuffer(store, np.uint8) if store is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array, accepts: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    inside = accepts[data]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside.copy()
    before[filled] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside.copy()
    after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), _hash_spans(data, starts, ends))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between one offset and the next."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def give_back() -> None:
    """Freed memory goes back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some ``SLICE_BYTES`` of text, so that memory doesn't follow the text length."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        piece = np.cumsum(sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
                give_back()


def on_slices(work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text") -> Callable:
    """A function for ``mapInArrow`` that applies ``work`` to slices of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            yield work(batch)

    return run


def signed(values: np.ndarray) -> np.ndarray:
    """Hashes as Spark's long."""
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column: row j holds ``values[bounds[j]:bounds[j+1]]``."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
