"""Byte-exact dedup of strings of 50 bytes by distributed prefix doubling.

Positions are ranked by the bytes that follow, over lengths that double: two positions have
the same rank at length 2h if they have the same rank at h and so have the positions h
further on.  A position whose rank no other document has is done and drops out.

* The first round ranks 25 bytes.  It need not look at every position: of the 26 that
  start in any 50 bytes the one of least hash is the same in every copy.  Pairs of rank and
  position are dealt by rank and sorted, and unique ranks drop out with all windows that
  hang on them (:mod:`nearprint.llm.windows`).
* The second round works on all positions around those left, dealt by the rank that they
  share: the rank at 50 is the pair of ranks at 25 here and 25 bytes further on.  That is
  past the threshold, so the smallest document of each rank is the answer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearprint.llm import codes
from nearprint.llm.substrings import _ids
from nearprint.llm.windows import Units, repeated

THRESHOLD = 50
START = 25

DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
REMOVED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, span_starts array<bigint>, span_ends array<bigint>, kept binary"


def doubled_rank(units: Units, at: np.ndarray, window: int) -> np.ndarray:
    """Ranks at ``window`` bytes, doubled up from ranks at ``START``; the last step may overlap."""
    length = min(START, window)
    ranks = codes.gram_hash(units.sums, length)
    while length < window:
        step = min(length, window - length)
        m = len(ranks) - step
        ranks = codes.mix(ranks[:m] * np.uint64(0x9E3779B97F4A7C15) + ranks[step:])
        length += step
    return ranks[at]


def _spans(units: Units, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs, and where each document's begin."""
    first = np.zeros(len(covered) + 1, bool)
    first[units.bounds] = True
    edge = covered.copy()
    edge[1:] &= ~covered[:-1] | first[1 : len(covered)]
    last = covered.copy()
    last[:-1] &= ~covered[1:] | first[1 : len(covered)]
    starts, ends = np.flatnonzero(edge), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, units.bounds)


def _parts(units: Units, covered: np.ndarray):
    n = np.diff(units.bounds)
    removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[units.bounds])
    starts, ends, at = _spans(units, covered)
    kept = units.buf[~covered].tobytes()
    left = np.concatenate([[0], np.cumsum(n - removed)]).tolist()
    return n, removed, starts, ends, at, [kept[a:b] for a, b in zip(left[:-1], left[1:], strict=True)]


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The spans removed of every document, in bytes of its UTF-8 text, and the bytes left.

    What is left need not be whole characters.  Null and empty texts have no bytes.  Rows
    that repeat an id do not remove bytes of each other.  An empty table gives no rows.
    """

    def finish(documents: pa.Table, units: Units, covered: np.ndarray) -> pa.Table:
        n, removed, starts, ends, at, kept = _parts(units, covered)
        base = np.repeat(units.bounds[:-1], np.diff(at))
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(side - base, pa.int64())) for side in (starts, ends)]
        columns = [_ids(documents), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(np.diff(at), pa.int64()), *lists, pa.array(kept, pa.binary())]
        return pa.Table.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "span_starts", "span_ends", "kept"])

    return repeated(docs, "bytes", threshold, min(START, threshold), finish, REMOVED, doubled_rank, id_column, text)


def digest(docs: DataFrame) -> DataFrame:
    """The same with the hash of the bytes left in place of the bytes and spans."""

    def finish(documents: pa.Table, units: Units, covered: np.ndarray) -> pa.Table:
        n, removed, _, _, at, kept = _parts(units, covered)
        columns = [
            _ids(documents), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(np.diff(at), pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        ]
        return pa.Table.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated(docs, "bytes", THRESHOLD, START, finish, DIGEST, doubled_rank)
