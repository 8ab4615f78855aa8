"""Which windows of a fixed number of units also start in a document of smaller id.

The units of a text are its words or its bytes.  Of the grams inside a window the one of
least hash is its *minimiser*.  Consecutive windows with the same minimiser form a run, and
equal windows have equal minimisers wherever they are, so a run says all about its windows.

Documents are grouped into blocks by a hash, and everything that travels is one row for each
block and bucket, with packed arrays in it.  So that these rows do not grow with the square of the
input, a block holds some megabytes of text; it is worked on in pieces that fit a cache:

1.  every run sends its minimiser, 6 bytes, to its bucket.  Sorting there shows which ones
    occur in two documents or more, and a bit for each run goes back to its block;
2.  the runs whose bit is set, as one packed string each, go to the bucket of their
    minimiser.  Equal strings of a block travel once.  There the windows are counted exactly:
    sorted by content, with the smallest id for each;
3.  the runs of windows that a smaller id has go back to the block.

A minimiser that very many runs share would overfill its bucket.  Runs of such a minimiser
are cut into their single windows, which are dealt by their own hash; equal ones are still
merged in each block.

Text is shuffled once, by block; the three steps read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearprint.llm import codes
from nearprint.llm.tables import buckets, doc_key

#: Bytes of text in a block, on average: the least, to keep all cores busy, and the most.
LEAST_BYTES = 1 << 20
BLOCK_BYTES = 12 << 20
#: Blocks that are enough for any number of cores a small input needs.
BLOCKS = 64
#: Bytes of text that are hashed at a time; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Runs beyond which the runs of one minimiser are cut into windows.
HOT_RUNS = 4096
KEY_BYTES = 6

ASKED = "block bigint, bucket int, keys binary, docs binary"
ANSWERED = "block bigint, bucket int, flags binary"
SENT = "block bigint, bucket int, sizes binary, bytes binary, which binary, docs binary, firsts binary"
FOUND = "block bigint, starts binary, counts binary"


class Units:
    """The words or bytes of a table of texts, with running sums for hashing stretches of them."""

    def __init__(self, kind: str, buf: np.ndarray, places: np.ndarray):
        self.buf = buf
        if kind == "words":
            words = codes.Words(buf, places)
            self.start, self.end, self.bounds = words.start, words.end, words.bounds
            values = words.hashes(codes.rolling(buf)) if len(buf) else np.zeros(0, np.uint64)
            self.sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * codes.power_tables(len(values))[0], out=self.sums[1:])
        else:
            self.start, self.end, self.bounds = None, None, places
            self.sums = codes.rolling(buf)
        self.text = np.repeat(np.arange(len(places) - 1, dtype=np.int32), np.diff(self.bounds))

    def grams(self, length: int) -> np.ndarray:
        return codes.gram_hash(self.sums, length)

    def window_starts(self, length: int) -> np.ndarray:
        """Units at which a whole window of one text starts."""
        m = len(self.text) - length + 1
        return np.flatnonzero(self.text[:m] == self.text[length - 1 :]) if m > 0 else np.zeros(0, np.int64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    have, least = 1, values
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = width - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def blocks_of(n_bytes: int, partitions: int) -> int:
    """Blocks for so many bytes of text: enough to deal out, and none far beyond ``BLOCK_BYTES``."""
    return max(1, -(-n_bytes // BLOCK_BYTES), min(-(-n_bytes // LEAST_BYTES), max(partitions, BLOCKS)))


def pieces(kind: str, docs: pa.Table) -> Iterator[tuple[int, int, Units]]:
    """``(first, end, units)``: consecutive texts of a block, a piece at a time."""
    sizes = pc.fill_null(pc.binary_length(docs.column("text")), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + PIECE_BYTES, "right")))
        yield at, end, Units(kind, *codes.flat(docs.column("text").slice(at, end - at)))
        at = end


class Runs:
    """Runs of consecutive windows with one minimiser: their key, first unit, windows, text."""

    def __init__(self, units: Units, window: int, gram: int):
        at = units.window_starts(window)
        if not len(at):
            self.key = np.zeros(0, np.uint64)
            self.first = self.count = np.zeros(0, np.int64)
            self.text = np.zeros(0, np.int32)
            return
        key = sliding_least(units.grams(gram), window - gram + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (units.text[at[1:]] != units.text[at[:-1]])
        where = np.flatnonzero(new)
        self.key = codes.mix(key[where])  # least values are small: mixed, they spread over buckets
        self.first = at[where]
        self.count = np.diff(np.append(where, len(at)))
        self.text = units.text[self.first]


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(48)) * np.uint64(n) >> np.uint64(16)).astype(np.int32)


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Bucket numbers with the places of their entries, in order."""
    order = np.argsort(bucket, kind="stable")
    distinct, first = np.unique(bucket[order], return_index=True)
    return list(zip(distinct.tolist(), np.split(order, first[1:]), strict=True)) if len(bucket) else []


def _sorted(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("doc", "ascending"), ("text", "ascending")])


def _table(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    return _table(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in schema.split(", ")])


def _pressed(values: np.ndarray) -> bytes:
    """Letters and small numbers take half the room that the shuffle's own compression leaves them."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8))


def _loosened(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _packed_keys(key: np.ndarray) -> bytes:
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _unpacked_keys(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return wide.view("<u8").ravel()


def ask(kind: str, window: int, gram: int, n: int) -> Callable[[pa.Table], pa.Table]:
    def run(docs: pa.Table) -> pa.Table:
        docs = _sorted(docs)
        found = [(runs.key, runs.text + start) for start, _, units in pieces(kind, docs) for runs in [Runs(units, window, gram)]]
        key, text = (np.concatenate(c) for c in zip(*found, strict=True))
        block = docs.column("block")[0].as_py()
        return _rows(ASKED, [
            (block, b, _packed_keys(key[at]), text[at].astype("<u4").tobytes()) for b, at in _by_bucket(bucket_of(key, n))
        ])

    return run


def _group_starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def answer(asked: pa.Table) -> pa.Table:
    """Two flags for each run: its minimiser is in two documents or more; it is a hot one."""
    rows = asked.to_pylist()
    keys = [_unpacked_keys(r["keys"]) for r in rows]
    sizes = [len(k) for k in keys]
    key = np.concatenate(keys)
    doc = np.concatenate([np.frombuffer(r["docs"], "<u4").astype(np.int64) + (i << 32) for i, r in enumerate(rows)])
    order = np.argsort(key, kind="stable")
    starts = _group_starts(key[order])
    size = np.diff(np.append(starts, len(key)))
    doc = doc[order]
    several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
    flags = np.zeros(len(key), np.uint8)
    flags[order] = np.repeat(several.astype(np.uint8) + (several & (size > HOT_RUNS)).astype(np.uint8), size)
    return _rows(ANSWERED, [
        (r["block"], r["bucket"], np.packbits(np.stack([own > 0, own > 1])).tobytes())
        for r, own in zip(rows, np.split(flags, np.cumsum(sizes)[:-1]), strict=True) if own.any()
    ])


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all stretches one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``data`` laid end to end."""
    return data[_places(start, size)]


def _strings(
    buf: np.ndarray, places: tuple[np.ndarray, np.ndarray] | None, first: np.ndarray, length: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Packed strings of ``length`` units from ``first`` on, and their sizes in bytes; words, which
    start and end at ``places`` of ``buf``, get one space each."""
    if places is None:
        return _gather(buf, first, length), length
    word = _places(first, length)
    width = (places[1] - places[0])[word] + 1
    data = _gather(np.append(buf, np.uint8(32)), places[0][word], width)
    data[np.cumsum(width) - 1] = 32
    return data, np.add.reduceat(width, np.cumsum(length) - length) if len(length) else length


def _single_hashes(kind: str, docs: pa.Table, base: list[int], single: np.ndarray, window: int) -> np.ndarray:
    """The content of windows that start at units ``single``, in order; pieces begin at ``base``."""
    out, edges = np.zeros(len(single), np.uint64), np.searchsorted(single, base)
    if len(single):
        for k, (_, _, units) in enumerate(pieces(kind, docs)):
            own = single[edges[k] : edges[k + 1]] - base[k]
            out[edges[k] : edges[k + 1]] = codes.spans_hash(units.sums, own, own + window)
    return out


def send(kind: str, window: int, gram: int, n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _rows(SENT, [])
        docs = _sorted(docs)
        found, words, base, origin = [], [], [0], 0
        for start, _, units in pieces(kind, docs):
            runs = Runs(units, window, gram)
            content = codes.spans_hash(units.sums, runs.first, runs.first + runs.count + window - 1)
            found.append((runs.key, runs.first + base[-1], runs.count, runs.text + start, content))
            if units.start is not None:
                words.append((units.start + origin, units.end + origin))
            base.append(base[-1] + len(units.text))
            origin += len(units.buf)
        key, first, count, text, content = (np.concatenate(c) for c in zip(*found, strict=True))
        places = dict(_by_bucket(bucket_of(key, n)))
        shared, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
        for row in answers.to_pylist():
            at = places[row["bucket"]]
            bits = np.unpackbits(np.frombuffer(row["flags"], np.uint8))[: 2 * len(at)].reshape(2, -1)
            shared[at], hot[at] = bits[0] == 1, bits[1] == 1
        whole, cut = np.flatnonzero(shared & ~hot), np.flatnonzero(hot)
        single = _places(first[cut], count[cut])
        alone = _single_hashes(kind, docs, base, single, window)
        text = np.concatenate([text[whole], np.repeat(text[cut], count[cut])])
        first = np.concatenate([first[whole], single])
        stretch = np.concatenate([count[whole], np.ones(len(single), np.int64)]) + window - 1
        content = np.concatenate([content[whole], alone])
        key = np.concatenate([key[whole], alone])
        buf = codes.flat(docs.column("text"))[0]
        words = tuple(np.concatenate(c) for c in zip(*words, strict=True)) or None
        doc = docs.column("doc").to_numpy()
        block = docs.column("block")[0].as_py()
        rows = []
        for b, at in _by_bucket(bucket_of(key, n)):
            _, some, which = np.unique(content[at], return_index=True, return_inverse=True)
            data, size = _strings(buf, words, first[at][some], stretch[at][some])
            rows.append((
                block, b, _pressed(size.astype("<u4")), _pressed(data), _pressed(which.astype("<u4")),
                _pressed(doc[text[at]].astype("<i8")), _pressed(first[at].astype("<u4")),
            ))
        return _rows(SENT, rows)

    return run


def count(kind: str, window: int, rank: Callable[[Units, np.ndarray, int], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """In each bucket: the smallest id with each window, and the windows for which it is smaller than one's own."""

    def run(sent: pa.Table) -> pa.Table:
        rows = sent.select(["block", "sizes", "which", "docs", "firsts"]).to_pylist()
        sizes = [_loosened(r["sizes"], "<u4").astype(np.int64) for r in rows]
        size = np.concatenate(sizes)
        buf = np.concatenate([_loosened(b.as_py(), "u1") for b in sent.column("bytes")])
        ends = np.cumsum(size)
        # Equal strings of different blocks become one.
        _, some, same = np.unique(codes.spans_hash(codes.rolling(buf), ends - size, ends), return_index=True, return_inverse=True)
        buf = _gather(buf, (ends - size)[some], size[some])
        places = np.concatenate([[0], np.cumsum(size[some])])
        units = Units(kind, buf, places)
        at = units.window_starts(window)
        bounds = np.searchsorted(units.text[at], np.arange(len(some) + 1))  # windows of each string
        base = np.cumsum([0, *(len(s) for s in sizes)])
        which = [same[_loosened(r["which"], "<u4").astype(np.int64) + base[i]] for i, r in enumerate(rows)]
        docs = [_loosened(r["docs"], "<i8") for r in rows]
        all_which, all_docs = np.concatenate(which), np.concatenate(docs)
        order = np.argsort(all_which, kind="stable")
        least = np.minimum.reduceat(all_docs[order], _group_starts(all_which[order]))  # each string has an owner
        own = np.repeat(least, np.diff(bounds))
        ranks = rank(units, at, window)
        order = np.argsort(ranks, kind="stable")
        starts = _group_starts(ranks[order])
        before = np.empty(len(at), np.int64)
        before[order] = np.repeat(np.minimum.reduceat(own[order], starts), np.diff(np.append(starts, len(at))))
        out = []
        for row, strings, doc in zip(rows, which, docs, strict=True):
            many = bounds[strings + 1] - bounds[strings]
            windows = _places(bounds[strings], many)
            first = _loosened(row["firsts"], "<u4").astype(np.int64)
            unit = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(windows))
            unit = np.sort(unit[before[windows] < np.repeat(doc, many)])
            if len(unit):
                starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1] + 1]))
                lengths = np.diff(np.append(starts, len(unit)))
                out.append((row["block"], unit[starts].astype("<u4").tobytes(), lengths.astype("<u4").tobytes()))
        return _rows(FOUND, out)

    return run


def content_rank(units: Units, at: np.ndarray, window: int) -> np.ndarray:
    """The same number for windows of the same content."""
    return codes.spans_hash(units.sums, at, at + window)


def stretches(found: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First unit, and the one after the last, of what lies under the windows found, by first unit."""
    rows = found.to_pylist()
    start, many = (np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(r[c], "<u4") for r in rows)]).astype(np.int64) for c in ("starts", "counts"))
    order = np.argsort(start, kind="stable")
    return start[order], (start + many + window - 1)[order]


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` units lie in a stretch."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge)[:-1] > 0


def repeated(
    docs: DataFrame, kind: str, window: int, gram: int, finish: Callable[[pa.Table, Units, np.ndarray], pa.Table], schema: str,
    rank: Callable[[Units, np.ndarray, int], np.ndarray] = content_rank, id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``finish(documents, units, covered)`` for every block of documents.

    ``documents`` has the columns ``doc`` (null ids as the largest number) and ``text``.
    Null texts have no units.  A smaller id is what counts: rows that share an id never
    cover each other, and null ids come after all others.
    """
    spark = docs.sparkSession
    n = 4 * buckets(spark)
    chosen = docs.select(doc_key(id_column).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_bytes = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = blocks_of(n_bytes, buckets(spark))
    blocked = chosen.select(F.pmod(F.xxhash64("doc", "text"), F.lit(blocks)).alias("block"), "doc", "text")
    by_block = blocked.groupBy("block")
    asked = by_block.applyInArrow(ask(kind, window, gram, n), ASKED)
    answered = asked.groupBy("bucket").applyInArrow(answer, ANSWERED)
    sent = by_block.cogroup(answered.groupBy("block")).applyInArrow(send(kind, window, gram, n), SENT)
    found = sent.groupBy("bucket").applyInArrow(count(kind, window, rank), FOUND)

    def end(documents: pa.Table, runs: pa.Table) -> pa.Table:
        documents = _sorted(documents)
        starts, ends = stretches(runs, window)
        done, out = 0, []
        # A stretch lies in one text, and so in one piece.
        for at, stop, units in pieces(kind, documents):
            n = len(units.text)
            own = slice(*np.searchsorted(starts, [done, done + n]))
            out.append(finish(documents.slice(at, stop - at), units, covered(n, starts[own] - done, ends[own] - done)))
            done += n
        return pa.concat_tables(out)

    return by_block.cogroup(found.groupBy("block")).applyInArrow(end, schema)
