"""Substring dedup: windows of 50 words that a document of smaller id has too are cut out.

Super-k-mer partitioning: consecutive windows that share a minimiser travel as one packed
string to the bucket of that minimiser, where sorting counts the windows exactly
(:mod:`nearprint.llm.windows`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearprint.llm.tables import LAST
from nearprint.llm.windows import Units, repeated

WINDOW = 50
GRAM = 20

SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


def _ids(documents: pa.Table) -> pa.Array:
    doc = documents.column("doc").to_numpy()
    return pa.array(doc, mask=doc == LAST)


def _kept(documents: pa.Table, units: Units, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    n = np.diff(units.bounds)
    removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[units.bounds])
    raw = units.buf.tobytes()
    start, end, stays = units.start.tolist(), units.end.tolist(), ~covered
    texts = []
    for a, b in zip(units.bounds[:-1].tolist(), units.bounds[1:].tolist(), strict=True):
        texts.append(b" ".join([raw[start[i] : end[i]] for i in (a + np.flatnonzero(stays[a:b])).tolist()]))
    return n, removed, texts


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)``: the words left, joined by one space.

    Null and empty texts, and those shorter than a window, lose nothing.  Rows that repeat
    an id do not remove words of each other.  An empty table gives no rows.
    """

    def finish(documents: pa.Table, units: Units, covered: np.ndarray) -> pa.Table:
        n, removed, texts = _kept(documents, units, covered)
        columns = [_ids(documents), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([t.decode("utf-8") for t in texts], pa.string())]
        return pa.Table.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text"])

    return repeated(docs, "words", window, gram, finish, SCHEMA, id_column=id_column, text=text)


def digest(docs: DataFrame, **options) -> DataFrame:
    """The same with the hash of the words left in place of the words."""

    def finish(documents: pa.Table, units: Units, covered: np.ndarray) -> pa.Table:
        n, removed, texts = _kept(documents, units, covered)
        columns = [_ids(documents), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
        return pa.Table.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeated(docs, "words", WINDOW, GRAM, finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", **options)
