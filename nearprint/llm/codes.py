"""Whole texts as numpy arrays: words, lines and hashes of Arrow batches.

The functions work on the bytes of a batch of texts laid end to end.  White space that
separates words is ASCII (``[\\x20\\x09-\\x0D]``), so words can be found on UTF-8 bytes.

Hashes are polynomials modulo 2**64 over fixed random byte values, finished by a mixing
step.  The hash of any stretch of bytes comes from two entries of one running sum.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; one longer text is a block of its own.
BLOCK_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def worker_state() -> dict:
    """What a Python process keeps between tasks; functions and modules travel anew with each."""
    return sys.modules.setdefault("nearprint_worker_state", ModuleType("nearprint_worker_state")).__dict__


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for blocks of the usual size."""
    usual = BLOCK_BYTES + 1
    if n > usual:
        return _powers(_BASE, n), _powers(_INVERSE, n)
    state = worker_state()
    if "powers" not in state:
        state["powers"] = _powers(_BASE, usual), _powers(_INVERSE, usual)
    return state["powers"][0][:n], state["powers"][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where each begins and ends.  Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or places[-1] == places[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``BLOCK_BYTES`` of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def rolling(buf: np.ndarray) -> np.ndarray:
    """Running sums of the byte values, each times its power of the base; one entry more than bytes."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUES[buf] * power_tables(len(buf))[0], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = power_tables(len(sums))[1]
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes that start at each place."""
    n = len(sums) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[length:] - sums[:n]) * power_tables(len(sums))[1][:n])


class Words:
    """The words of a block: where they start and end, their text, and how many each text has."""

    def __init__(self, buf: np.ndarray, places: np.ndarray):
        n = len(buf)
        inside = ~SPACE[buf]
        first = np.zeros(n + 1, bool)
        first[places] = True
        starts = inside.copy()
        ends = inside.copy()
        if n:
            starts[1:] &= ~inside[:-1] | first[1:n]
            ends[:-1] &= ~inside[1:] | first[1:n]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        #: words of text i are those from bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.start, places)
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(places) - 1), self.counts)

    def hashes(self, sums: np.ndarray) -> np.ndarray:
        return spans_hash(sums, self.start, self.end)


def word_grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` consecutive words from each word on, across texts; fewer than words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(_BASE) + h[k : k + m])
    return out


def char_counts(buf: np.ndarray) -> np.ndarray:
    """Running counts of code points."""
    return np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])


def string_column(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
