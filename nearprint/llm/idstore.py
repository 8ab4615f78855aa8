"""Token ids in shards, with an index for keyed access.

The format is a folder of two Parquet tables.  A row of ``shards`` is one shard: the keys of
its documents in ascending order, where the ids of each begin, and the raw little-endian
ids, two bytes each where the vocabulary allows.  A row of ``index`` covers the keys of one
hash bucket: a minimal perfect hash gives every key a slot of its own, and the slot holds a
fingerprint of the key and its place (range, shard, position in the shard).  A look-up thus
costs a hash, a comparison and a slice.  Spark's writers commit the files, so a lost
executor leaves no half-written shard.

The perfect hash is built in levels: keys that are alone in a cell of a bit table are done,
the others go on to the next, smaller table.  The slot is the number of set bits before.

A key is an id and, for rows that repeat an id, the number of its occurrence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearprint.llm import codes
from nearprint.llm.tables import buckets, doc_key, new_folder
from nearprint.llm.tokens import Encoder, largest_id, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Ids after which a shard is closed.
SHARD_IDS = 2_000_000
FINGERPRINT_BITS = 16

SHARDS = "range int, shard int, n_docs int, n_ids bigint, width int, keys binary, occurrences binary, starts binary, ids binary"


def code(keys: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
    return codes.mix(codes.mix(keys.astype(np.uint64)) + occurrences.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """Slots 0 to n-1 for n distinct codes."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        self.before = [np.cumsum(t) - t for t in tables]
        self.base = np.concatenate([[0], np.cumsum([int(t.sum()) for t in tables])]).astype(np.int64)

    @classmethod
    def build(cls, distinct: np.ndarray) -> PerfectHash:
        tables, left = [], distinct
        while len(left):
            cell = cls._cell(left, len(tables), max(8, len(left) * 5 // 4))
            alone = np.bincount(cell, minlength=max(8, len(left) * 5 // 4)) == 1
            tables.append(alone.astype(np.int64))
            left = left[~alone[cell]]
        return cls(tables)

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (codes.mix(keys + np.uint64((level + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each code, -1 for one that falls through all tables."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, table in enumerate(self.tables):
            cell = self._cell(keys[left], level, len(table))
            hit = table[cell] == 1
            out[left[hit]] = self.base[level] + self.before[level][cell[hit]]
            left = left[~hit]
        return out

    def pack(self) -> tuple[bytes, bytes]:
        sizes = np.array([len(t) for t in self.tables], "<i8").tobytes()
        return sizes, b"".join(np.packbits(t.astype(np.uint8)).tobytes() for t in self.tables)

    @classmethod
    def unpack(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        tables, at = [], 0
        for size in np.frombuffer(sizes, "<i8").tolist():
            n = (size + 7) // 8
            tables.append(np.unpackbits(np.frombuffer(bits, np.uint8, n, at))[:size].astype(np.int64))
            at += n
        return cls(tables)


def _shards(path: str, end_id: int, limit: int, wide: bool):
    kind = "<u4" if wide else "<u2"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, "keep")
        part, number = TaskContext.get().partitionId(), 0
        keys, sizes, streams, last, count = [], [], [], None, 0
        occurrences: list[int] = []

        def row() -> pa.RecordBatch:
            size = np.concatenate(sizes)
            starts = np.concatenate([[0], np.cumsum(size)])
            values = [
                part, number, len(starts) - 1, int(starts[-1]), np.dtype(kind).itemsize, np.concatenate(keys).astype("<i8").tobytes(),
                np.array(occurrences, "<i8").tobytes(), starts.astype("<i8").tobytes(), b"".join(streams),
            ]
            names = [f.split()[0] for f in SHARDS.split(", ")]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        held = 0
        for block in codes.blocks(batches):
            ids, at = encoder.encode(*codes.flat(block.column("text")))
            key = block.column("key").to_numpy()
            for k in key.tolist():
                count = count + 1 if k == last else 0
                last = k
                occurrences.append(count)
            keys.append(key)
            sizes.append(np.diff(at) + 1)
            streams.append(np.insert(ids, at[1:], end_id).astype(kind).tobytes())
            held += len(ids) + len(key)
            if held >= limit:
                yield row()
                keys, sizes, streams, occurrences, held, number = [], [], [], [], 0, number + 1
        if keys:
            yield row()

    return write


def write(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, limit: int = SHARD_IDS, wide: bool | None = None,
    id_column: str = "doc_id", text: str = "text",
) -> None:
    """Encode the texts and write shards in ascending id order, null last, and their index.

    ``wide`` stores four bytes an id; by default it is taken from the largest id there is, and two
    bytes are refused where that does not fit.  Null and empty texts are the end id alone.  An
    empty table gives shards and an index without rows.  A text of any length is one entry.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path(TOKENIZER)
    large = max(largest_id(path), end_id) >= 1 << 16
    if wide is False and large:
        raise ValueError("ids of this vocabulary need four bytes")
    wide = large if wide is None else wide
    n = buckets(spark)
    chosen = docs.select(doc_key(id_column).alias("key"), F.col(text).alias("text"))
    ordered = chosen.repartitionByRange(n, "key").sortWithinPartitions("key", "text")
    shards = ordered.mapInArrow(_shards(path, end_id, limit, wide), SHARDS)
    shards.write.option("compression", "zstd").parquet(f"{folder}/shards")
    places = shard_keys(spark, folder).select("key", "occurrence", "range", "shard", "position", "bucket")
    places.groupBy("bucket").applyInArrow(_index, INDEX).write.parquet(f"{folder}/index")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(f"{folder}/shards")


INDEX = "bucket int, sizes binary, bits binary, fingerprints binary, ranges binary, shards binary, positions binary"
KEYS = "key bigint, occurrence bigint, range int, shard int, position bigint, bucket int"


def shard_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The keys the shards hold, with their place and index bucket.  Reads no ids."""
    n = buckets(spark)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, occurrence = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["occurrences"], "<i8")
                bucket = (code(key, occurrence) >> np.uint64(40)) % np.uint64(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key), pa.array(occurrence), pa.array(np.full(len(key), row["range"], np.int32)),
                        pa.array(np.full(len(key), row["shard"], np.int32)), pa.array(np.arange(len(key))), pa.array(bucket.astype(np.int32)),
                    ],
                    ["key", "occurrence", "range", "shard", "position", "bucket"],
                )

    return read_shards(spark, folder).select("range", "shard", "keys", "occurrences").mapInArrow(spell, KEYS)


def _index(entries: pa.Table) -> pa.Table:
    codes_of = code(entries.column("key").to_numpy(), entries.column("occurrence").to_numpy())
    hashed = PerfectHash.build(codes_of)
    order = np.argsort(hashed.slots(codes_of))
    sizes, bits = hashed.pack()
    columns = [
        sizes, bits, (codes_of[order] & np.uint64(2**FINGERPRINT_BITS - 1)).astype("<u2").tobytes(),
        *(entries.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("range", "shard", "position")),
    ]
    names = [f.split()[0] for f in INDEX.split(", ")]
    first = entries.column("bucket").slice(0, 1).combine_chunks()
    return pa.Table.from_arrays([first, *(pa.array([c], pa.binary()) for c in columns)], names)


def locate(keys: DataFrame, folder: str) -> DataFrame:
    """``(key, occurrence, range, shard, position)`` of those keys that the index knows.

    A key that was never written is told apart by its fingerprint, up to one in 2**16.
    """
    spark = keys.sparkSession
    n = buckets(spark)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, occurrence = batch.column("key"), batch.column("occurrence")
            bucket = (code(key.to_numpy(), occurrence.to_numpy()) >> np.uint64(40)) % np.uint64(n)
            yield pa.RecordBatch.from_arrays([key, occurrence, pa.array(bucket.astype(np.int32))], ["key", "occurrence", "bucket"])

    def look_up(asked: pa.Table, index: pa.Table) -> pa.Table:
        names = ["key", "occurrence", "range", "shard", "position"]
        if not asked.num_rows or not index.num_rows:
            empty = [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())]
            return pa.Table.from_arrays(empty, names)
        row = index.to_pylist()[0]
        key, occurrence = asked.column("key").to_numpy(), asked.column("occurrence").to_numpy()
        asked_codes = code(key, occurrence)
        slot = PerfectHash.unpack(row["sizes"], row["bits"]).slots(asked_codes)
        known = slot >= 0
        prints = np.frombuffer(row["fingerprints"], "<u2")
        known[known] = prints[slot[known]] == (asked_codes[known] & np.uint64(2**FINGERPRINT_BITS - 1)).astype(np.uint16)
        place = [np.frombuffer(row[c], "<i8")[slot[known]] for c in ("ranges", "shards", "positions")]
        return pa.Table.from_arrays(
            [pa.array(key[known]), pa.array(occurrence[known]), pa.array(place[0].astype(np.int32)), pa.array(place[1].astype(np.int32)), pa.array(place[2])],
            names,
        )

    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    asked = keys.select(F.col("key").cast("long"), F.col("occurrence").cast("long")).mapInArrow(dealt, "key bigint, occurrence bigint, bucket int")
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look_up, "key bigint, occurrence bigint, range int, shard int, position bigint")


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """``(range, shard, base)``: how many ids all shards before hold.  One row per shard, one per range in a window."""
    sizes = read_shards(spark, folder).select("range", "shard", "n_ids")
    in_range = Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("range").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("ahead"))
    within = sizes.select("range", "shard", F.coalesce(F.sum("n_ids").over(in_range), F.lit(0)).alias("inside"))
    return within.join(ranges, "range").select("range", "shard", (F.col("ahead") + F.col("inside")).alias("base"))


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """``(range, shard, position, at, n_tokens, ids_crc32)`` of all documents, from the raw ids."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["starts"], "<i8")
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["range"], np.int32)), pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.arange(n)),
                        pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64()),
                    ],
                    ["range", "shard", "position", "at", "n_tokens", "ids_crc32"],
                )

    schema = "range int, shard int, position bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    return read_shards(spark, folder).select("range", "shard", "width", "starts", "ids").mapInArrow(spell, schema)


def digest(keys: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of the given ``(key, occurrence)`` rows."""
    spark = keys.sparkSession
    place = ["range", "shard", "position"]
    found = locate(keys, folder).join(payloads(spark, folder), place).join(starts(spark, folder), ["range", "shard"])
    return found.select(
        F.when(F.col("key") != 2**63 - 1, F.col("key")).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_and_read(docs: DataFrame, **options) -> DataFrame:
    """Write a store to a new shared folder and read every document back by its key."""
    spark = docs.sparkSession
    folder = new_folder(spark, "ids")
    write(docs, folder, **options)
    return digest(shard_keys(spark, folder).select("key", "occurrence"), folder)
