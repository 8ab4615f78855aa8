"""Line dedup by overlapping windows of three lines.

A window is three consecutive lines that hold a word (lines without one are passed over).
A window that occurred before, in a document of smaller id or further up in the same one, is
a repetition, and all lines that any such window covers are removed, the positions of
overlapping windows merged.  Documents of fewer than three such lines are left alone.

Only hashes are shuffled to find the windows, one row for each document and window, and
partial minima make a window that is everywhere cost one row a task.  Windows are judged on
the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearprint.llm import codes
from nearprint.llm.tables import doc_key, own_names

WINDOW = 3
WINDOWS = "doc bigint, window bigint, proof int"


class Lines:
    """Lines of a block and the windows of those that hold a word."""

    def __init__(self, buf: np.ndarray, places: np.ndarray, length: int = WINDOW):
        breaks = np.flatnonzero(buf == 0x0A)
        self.start = np.sort(np.concatenate([places[:-1], breaks + 1]))
        self.end = np.sort(np.concatenate([breaks, places[1:]]))
        # A text has one line more than line breaks.
        per_text = np.diff(np.searchsorted(breaks, places)) + 1
        self.text = np.repeat(np.arange(len(places) - 1), per_text)
        words = codes.Words(buf, places)
        self.full = np.searchsorted(words.start, self.end) > np.searchsorted(words.start, self.start)
        self.hash = codes.spans_hash(codes.rolling(buf), self.start, self.end) if len(buf) else np.zeros(len(self.start), np.uint64)
        #: lines that hold a word, and the first of such lines of each window
        self.used = np.flatnonzero(self.full)
        text, h = self.text[self.used], self.hash[self.used]
        m = max(0, len(self.used) - length + 1)
        whole = text[:m] == text[length - 1 :] if m else np.zeros(0, bool)
        self.at = np.flatnonzero(whole)
        self.window = codes.word_grams(h, length)[self.at] if m else np.zeros(0, np.uint64)
        self.window_text = text[self.at]
        # 32 more bits, so that two windows of one hash are told apart in large corpora.
        proof = codes.word_grams(codes.mix(h + np.uint64(0x5851F42D4C957F2D)), length)[self.at] if m else self.window
        self.proof = (proof >> np.uint64(33)).astype(np.int32)


def repeated_windows(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """``(doc, seen)``: the windows of a document that also occur in one of smaller id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in codes.blocks(batches):
            lines = Lines(*codes.flat(block.column("text")), length)
            doc = block.column("doc").to_numpy()[lines.window_text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(lines.window.view(np.int64)), pa.array(lines.proof)], ["doc", "window", "proof"]
            )

    windows = docs.mapInArrow(emit, WINDOWS)
    first = windows.groupBy("window", "proof").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    later = windows.join(first, ["window", "proof"]).where(F.col("doc") > F.col("first"))
    return later.groupBy("doc").agg(F.collect_set("window").alias("seen"))


def covered(lines: Lines, seen: list[np.ndarray], length: int = WINDOW) -> np.ndarray:
    """Which lines of a block lie under a window that occurred before."""
    again = np.zeros(len(lines.at), bool)
    if len(lines.at):
        order = np.lexsort((lines.at, lines.window, lines.window_text))
        same = (lines.window[order][1:] == lines.window[order][:-1]) & (lines.window_text[order][1:] == lines.window_text[order][:-1])
        again[order[1:][same]] = True
        bounds = np.searchsorted(lines.window_text, np.arange(len(seen) + 1))
        for i, known in enumerate(seen):
            if known is not None and len(known):
                a, b = bounds[i], bounds[i + 1]
                again[a:b] |= np.isin(lines.window[a:b], known)
    under = np.zeros(len(lines.used) + 1, np.int64)
    np.add.at(under, lines.at[again], 1)
    np.add.at(under, lines.at[again] + length, -1)
    out = np.zeros(len(lines.start), bool)
    out[lines.used] = np.cumsum(under)[:-1] > 0
    return out


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = WINDOW, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All rows and columns, ``text`` without the lines removed, and under the names ``counts`` how many
    lines there were and how many were removed.  Columns that had these names before give way.

    A null text stays null and has no lines.  Null ids order after all others.  Documents
    that share an id do not come before each other.  Empty texts have one line, without words, and
    stay; a long text is one block of its own.  An empty table gives no rows.
    """
    docs = docs.drop(*counts)
    own, key, held = own_names(docs, "own_key", "seen_key", "seen_before")
    keyed = docs.select("*", doc_key(id_column).alias(own))
    seen = repeated_windows(keyed.select(F.col(own).alias("doc"), F.col(text).alias("text")), length)
    joined = keyed.join(seen.withColumnsRenamed({"doc": key, "seen": held}), F.col(own) == F.col(key), "left")
    names = docs.columns
    at = names.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in codes.blocks(batches, text):
            buf, places = codes.flat(block.column(text))
            lines = Lines(buf, places, length)
            seen = [None if s is None else np.array(s, np.int64).view(np.uint64) for s in block.column(held).to_pylist()]
            gone = covered(lines, seen, length)
            removed = np.bincount(lines.text[gone], minlength=len(seen))
            texts = block.column(text).to_pylist()
            raw = buf.tobytes()
            bounds = np.searchsorted(lines.text, np.arange(len(seen) + 1))
            for i in np.flatnonzero(removed).tolist():
                own = range(bounds[i], bounds[i + 1])
                texts[i] = b"\n".join(raw[lines.start[j] : lines.end[j]] for j in own if not gone[j]).decode("utf-8")
            count = np.diff(bounds)
            count[block.column(text).is_null().to_numpy(zero_copy_only=False)] = 0
            columns = [block.column(c) for c in names]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count.astype(np.int64)), pa.array(removed.astype(np.int64))], [*names, *counts])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.select(*names, held).mapInArrow(apply, f"{kinds}, {counts[0]} bigint, {counts[1]} bigint")
