"""Threshold-scaled fingerprints, in DataFrame functions only.

The fingerprint of a text holds the hash of every five-word shingle that lies below a fixed
fraction of the hash range.  Whether a hash is kept depends on nothing but itself, so the
fingerprint of a union is the union of fingerprints, and the share of one text that another
contains can be estimated however unequal their sizes.

Words are runs without ASCII white space; a text of fewer than five words is one shingle,
one without words has none.  Where no hash lies below the limit the smallest one is kept, so that
only wordless texts have an empty fingerprint; that choice too depends on the text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearprint.llm.codes import WORD

SHINGLE = 5
#: One hash in this many is kept.
SCALE = 4
#: Neighbouring ids that are ordered in one place, as a power of two.
BLOCK_BITS = 8
SUPER_BITS = 12
#: Stands for a null id, which orders last.
NO_ID = -(2**63)


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """The kept hashes, sorted.  Each array is bound to a lambda variable, so it is made once."""
    limit = F.lit(-(2**63) + 2**64 // scale).cast("long")
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def grams(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - shingle)
        rolled = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(shingle)]))
        short = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(hashes) >= shingle, rolled).otherwise(short)

    def low(all_: Column) -> Column:
        below = F.filter(all_, lambda g: g < limit)
        return F.when((F.size(all_) == 0) | F.exists(all_, lambda g: g < limit), below).otherwise(F.array(F.array_min(all_)))

    hashed = F.transform(F.array(words), lambda w: F.transform(w, lambda x: F.xxhash64(x)))
    kept = F.transform(F.transform(hashed, grams), low)
    return F.sort_array(F.array_distinct(F.get(kept, F.lit(0))))


def spell(hashes: Column) -> Column:
    """A fingerprint as a string: 16 hex digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller fingerprint that the other one holds.

    1 for equal ones, also empty ones; 0 where one alone is empty.
    """
    least = F.least(F.size(a), F.size(b))
    return F.when(a == b, F.lit(1.0)).when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def _next_blocks(blocks: DataFrame) -> DataFrame:
    """``(block, next)``: the next lower block, the highest after the lowest.

    Blocks are ordered within groups of 4,096 numbers, and the groups among each other.
    """
    high = blocks.withColumn("high", F.shiftright("block", SUPER_BITS))
    inside = Window.partitionBy("high").orderBy(F.col("block").desc())
    stepped = high.withColumn("inner", F.lead("block").over(inside))
    tops = high.groupBy("high").agg(F.max("block").alias("top"), F.min("block").alias("last"))
    order = Window.orderBy(F.col("high").desc())
    over_all = Window.partitionBy()
    tops = tops.select("last", F.coalesce(F.lead("top").over(order), F.max("top").over(over_all)).alias("outer"))
    joined = stepped.join(tops, F.col("block") == F.col("last"), "left")
    return joined.select("block", F.coalesce("inner", "outer").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """``(key, block, text, sketch)`` rows with the text and sketch of the next document.

    The next one is that of the next lower key; after the lowest comes the highest.  Texts
    are shuffled once.  Only the first row of a block is needed elsewhere, by the block
    before, and these rows are found before the shuffle.
    """
    order = Window.partitionBy("block").orderBy(F.col("key").desc(), "text")
    lead = lambda c: F.lead(c).over(order)
    rows = docs.withColumn("sketch", sketch(F.col("text"))).select(
        "*", lead("text").alias("lead_text"), lead("sketch").alias("lead_sketch"), F.lead(F.lit(1)).over(order).alias("has_lead")
    )
    first = docs.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    follows = _next_blocks(docs.select("block").distinct())
    feed = follows.join(first.select(F.col("block").alias("next"), F.col("text").alias("feed_text")), "next")
    feed = feed.select("block", "feed_text", sketch(F.col("feed_text")).alias("feed_sketch"))
    joined = rows.join(feed, "block", "left")
    here = F.col("has_lead").isNotNull()
    return joined.select(
        "key", "text", "sketch",
        F.when(here, F.col("lead_text")).otherwise(F.col("feed_text")).alias("next_text"),
        F.when(here, F.col("lead_sketch")).otherwise(F.col("feed_sketch")).alias("next_sketch"),
    )


def compare(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint against that of its edited text and of the next document.

    The edited text has the last half of the code points replaced by as many from the start
    of the next document.  Null texts count as empty.  Null ids come last; rows that share
    an id follow each other in the order of their texts.  A single document is its own next.
    """
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    keyed = docs.select(key.alias("key"), F.shiftright(key, BLOCK_BITS).alias("block"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(keyed).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    edited = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half)))
    sketched = edited.withColumn("edited_sketch", sketch(F.col("edited")))
    return sketched.select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        spell(F.col("sketch")).alias("fingerprint"), spell(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
