"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are cut into pieces of at most ``CAPACITY`` ids.  How many pieces there are of each
length is all the plan needs: at most ``CAPACITY`` counts, whatever the size of the corpus.
Best-fit, longest first, runs over these counts, many equal sequences at a time, and says
which sequences the first, second, ... piece of each length goes to.  A piece then takes
the slot planned for its rank within its length.  Ranks are given without ordering pieces
in one place: each task counts its own, and running sums of these counts over the tasks
are added.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearprint.llm import codes
from nearprint.llm.tables import materialise
from nearprint.llm.tokens import Encoder, tokenizer_path

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 1

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"


def encoded_pieces(
    docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in the same task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, "drop")
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for block in codes.blocks(batches):
            ids, at = encoder.encode(*codes.flat(block.column("text")))
            n = block.num_rows
            sizes = np.diff(at) + 1
            parts = -(-sizes // capacity)
            doc = np.repeat(np.arange(n), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            stream = np.insert(ids, at[1:], end_id).astype("<u4")
            begin = at[:-1][doc] + doc + start
            crc = np.fromiter((zlib.crc32(stream[b : b + m]) for b, m in zip(begin.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
            order = np.argsort(length, kind="stable")
            distinct, first, counts = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(first, counts) + np.repeat(seen[distinct], counts)
            seen[distinct] += counts
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(crc), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(pieces, PIECES)


class Plan:
    """Where the pieces of each length go: runs of ranks to runs of sequences, at one offset."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.sequences = 0
        self._runs: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        self._open: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
        self._rooms: list[int] = []
        for length in sorted(counts, reverse=True):
            self._place(length, counts[length])
        self._runs.sort()
        runs = np.array(self._runs, np.int64).reshape(-1, 4)
        self.key, self.first, self.sequence, self.offset = (runs[:, 0] << 44) + runs[:, 1], runs[:, 1], runs[:, 2], runs[:, 3]

    def _leave(self, room: int, first: int, many: int) -> None:
        if room and many:
            if room not in self._open:
                self._open[room] = []
                insort(self._rooms, room)
            self._open[room].append((first, many))

    def _place(self, length: int, count: int) -> None:
        rank = 0
        while rank < count:
            at = bisect_left(self._rooms, length)
            if at < len(self._rooms):
                room = self._rooms[at]
                first, many = self._open[room].pop()
                if not self._open[room]:
                    del self._open[room], self._rooms[at]
            else:  # new sequences, as many as the rest needs
                room, first = self.capacity, self.sequences
                many = -(-(count - rank) // (room // length))
                self.sequences += many
            each = room // length
            full = min(many, (count - rank) // each)
            for layer in range(each if full else 0):
                self._runs.append((length, rank, first, self.capacity - room + layer * length))
                rank += full
            self._leave(room - each * length, first, full)
            if full < many:  # one sequence takes what is left, if anything is
                rest = min(count - rank, each)
                for layer in range(rest):
                    self._runs.append((length, rank + layer, first + full, self.capacity - room + layer * length))
                rank += rest
                self._leave(room - rest * length, first + full, 1)
                self._leave(room, first + full + 1, many - full - 1)

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.key, self.first, self.sequence, self.offset


def find(plan: tuple[np.ndarray, ...], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces of given lengths and ranks."""
    key, first, sequence, offset = plan
    at = np.searchsorted(key, (length << 44) + rank, "right") - 1
    return sequence[at] + rank - first[at], offset[at]


def pack(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` per piece.

    A null or empty text is the end id alone.  Rows that repeat an id are packed each; a null
    id stays null.  An empty table gives no rows.
    """
    pieces = materialise(encoded_pieces(docs, path or tokenizer_path(TOKENIZER), end_id, capacity, id_column, text), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("pieces"))
    per_task = materialise(per_task, "piece-counts")
    counts = per_task.groupBy("length").agg(F.sum("pieces")).collect()  # a row for each length up to capacity
    plan = docs.sparkSession.sparkContext.broadcast(Plan({r[0]: r[1] for r in counts}, capacity).parts())
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_task.select("length", "task", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("ahead"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset = find(plan.value, length, batch.column("rank").to_numpy())
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema)
