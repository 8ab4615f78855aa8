"""Importance resampling towards a target collection, with a head-tail vocabulary.

Features are runs of one, or of one and two, consecutive words, joined by one space; a feature's
bucket is the CRC-32 of its bytes modulo ``BUCKETS``.  A CRC can be carried on: the state after a
word, taken further over a space and the next word, is the CRC of the pair.

The *head* is broadcast: for words that are frequent somewhere their exact CRC states, for such
pairs their buckets.  The *tail*, every feature not in the head, takes its CRC directly.  Both
routes give the same bucket, so the head decides about speed only and the bucket totals are
exact over all texts.  The head has at most ``HEAD`` words and pairs of at most ``HEAD_BYTES``.

The gain of a bucket compares its share of the target with its share of the documents.  A
document's weight is the mean gain of its features, and Gumbel noise drawn from its id makes the
highest scores a sample without replacement.  Ranks are handed out from a histogram of the scores
(whole thousandths; gains and noise are logarithms, so there are at most some hundred thousand
values whatever the input), and within one score by id.

Null texts count as empty; an empty or wordless text has no feature and weight 0.  A long text is
read in pieces of ``PIECE_BYTES``.  A null id is drawn as the empty one and comes last among equal
scores; rows that repeat an id are documents of their own and share its noise; rows alike in id
and text take ranks that follow each other.  An empty table gives no rows, an empty target leaves
the noise and the smoothing to decide.  Columns of any other name are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearprint.llm import codes
from nearprint.llm.tables import materialise

BUCKETS = 10_000
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10
#: Entries of the head, words and pairs each, and the bytes of the longest.
HEAD = 8192
HEAD_BYTES = 64
#: A word that makes up one in so many of some piece of text may enter the head.
FREQUENT = 4096
PIECE_BYTES = 1 << 20

_KEPT = np.zeros(256, bool)
_KEPT[48:58] = _KEPT[97:123] = _KEPT[128:] = True
_LOWERED = np.where(_KEPT[codes.LOWER], codes.LOWER, 32).astype(np.uint8).tobytes()


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, piece by piece; no word is cut."""
    if len(text) <= PIECE_BYTES:
        yield text.translate(_LOWERED).split()
        return
    held: list[bytes] = []  # an unfinished word, in parts
    for at in range(0, len(text), PIECE_BYTES):
        part = text[at : at + PIECE_BYTES].translate(_LOWERED)
        end = part.rfind(b" ") + 1
        if not end:
            held.append(part)
            continue
        yield b"".join([*held, part[:end]]).split()
        held = [part[end:]]
    yield b"".join(held).split()


class Head:
    """Exact CRC states of frequent words, buckets of frequent pairs."""

    def __init__(self, words: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int], buckets: int):
        self.words, self.pairs, self.buckets = words, pairs, buckets

    def of(self, words: list[bytes], runs: int, last: bytes | None) -> np.ndarray:
        """Buckets of all features that end in ``words``; ``last`` is the word before them."""
        known = self.words.get
        states = [s if (s := known(w, -1)) >= 0 else crc32(w) for w in words]
        single = np.array(states, np.int64) % self.buckets
        if runs == 1 or not words:
            return single
        if last is not None:
            words, states = [last, *words], [s if (s := known(last, -1)) >= 0 else crc32(last), *states]
        paired, buckets = self.pairs.get, self.buckets
        found = [
            b if (b := paired((one, two), -1)) >= 0 else crc32(b" " + two, state) % buckets
            for one, two, state in zip(words, words[1:], states, strict=False)
        ]
        return np.concatenate([single, np.array(found, np.int64)])


def feature_pieces(text: bytes, head: Head, runs: int) -> Iterator[tuple[int, np.ndarray]]:
    """Words and feature buckets of a text, piece by piece."""
    last = None
    for words in word_pieces(text):
        yield len(words), head.of(words, runs, last)
        last = words[-1] if words else last


def texts(block: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [t or b"" for t in codes.string_column(block.column(name)).cast(pa.large_binary()).to_pylist()]


def _frequent(runs: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in codes.blocks(batches):
            seen, total = Counter(), 0
            for text in texts(block):
                for words in word_pieces(text):
                    seen.update(words)
                    total += len(words)
                    if runs == 2:
                        seen.update(zip(words, words[1:], strict=False))
            least = max(2, total // FREQUENT)
            rows = [(w, n) if isinstance(w, tuple) else ((w, None), n) for w, n in seen.items() if n >= least]
            rows = [(one, two, n) for (one, two), n in rows if len(one) + len(two or b"") <= HEAD_BYTES]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["one", "two", "many"]
            )

    return count


def fit_head(docs: DataFrame, text: str = "text", runs: int = 1, buckets: int = BUCKETS, size: int = HEAD) -> Head:
    """The most frequent of the words, and pairs, that are frequent in some piece of the texts.

    Gathers at most ``2 * size`` rows.
    """
    found = docs.select(F.col(text).alias("text")).mapInArrow(_frequent(runs), "one binary, two binary, many bigint")
    summed = found.groupBy("one", "two").agg(F.sum("many").alias("many"))
    top = lambda df: df.orderBy(F.col("many").desc(), "one", "two").limit(size).collect()
    words = {bytes(r.one): crc32(bytes(r.one)) for r in top(summed.where("two IS NULL"))}
    pairs = {}
    if runs == 2:
        pairs = {(bytes(r.one), bytes(r.two)): crc32(bytes(r.one) + b" " + bytes(r.two)) % buckets for r in top(summed.where("two IS NOT NULL"))}
    return Head(words, pairs, buckets)


def totals(sides: DataFrame, head: Head, runs: int = 1) -> np.ndarray:
    """Features of each bucket, a row a side, for ``(side, text)`` rows with side 0 or 1."""
    buckets = head.buckets
    shared = sides.sparkSession.sparkContext.broadcast((head.words, head.pairs, buckets))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, many = Head(*shared.value), np.zeros(2 * buckets, np.int64)
        for block in codes.blocks(batches):
            found = [
                at + side * buckets
                for side, text in zip(block.column("side").to_pylist(), texts(block), strict=True)
                for _, at in feature_pieces(text, here, runs)
            ]
            many += np.bincount(np.concatenate(found), minlength=2 * buckets)
        cell = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(many[cell])], ["cell", "many"])

    out = np.zeros(2 * buckets, np.int64)
    for row in sides.mapInArrow(count, "cell bigint, many bigint").groupBy("cell").agg(F.sum("many").alias("many")).collect():
        out[row.cell] = row.many
    return out.reshape(2, buckets)


def gains(many: np.ndarray) -> list[int]:
    """For each bucket, a thousand times the logarithm of target share over document share."""
    buckets = many.shape[1]
    s_all, t_all = (int(n) for n in many.sum(axis=1))
    return [
        math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
        for s, t in zip(many[0].tolist(), many[1].tolist(), strict=True)
    ]


def weights(docs: DataFrame, head: Head, gain: list[int], id_column: str = "doc_id", text: str = "text", runs: int = 1) -> DataFrame:
    """``(doc_id, mark, n_words, n_features, weight)``; ``mark`` is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast((head.words, head.pairs, head.buckets, np.array(gain, np.int64)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, table = shared.value
        here = Head(*parts)
        for block in codes.blocks(batches):
            rows = []
            for text in texts(block):
                words = features = total = 0
                for n, found in feature_pieces(text, here, runs):
                    words, features, total = words + n, features + len(found), total + int(table[found].sum())
                rows.append((words, features, total // features if features else 0))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("mark"), *columns], ["doc_id", "mark", "n_words", "n_features", "weight"])

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    return chosen.mapInArrow(weigh, "doc_id bigint, mark bigint, n_words bigint, n_features bigint, weight bigint")


def noise(id_column: Column, seed: str = SEED) -> Column:
    """Gumbel noise in whole thousandths, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def ranked(scores: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows of a written ``(doc_id, mark, n_words, n_features, weight, score)`` table with ``rank``.

    Rows alike in everything are counted before they meet, so a key they share is no hot one.
    """
    fit = F.col("n_words") >= min_words
    held = scores.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("many"))
    # One row for each score that occurs.
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = F.floor(F.sum("many").over(Window.partitionBy()) * percent / 100).cast("long")
    held = held.select("score", (F.sum("many").over(above) - F.col("many")).alias("before"), drawn.alias("wanted")).where("before < wanted")
    held = materialise(held, "resample-scores-held")
    cut = held.agg(F.min("score").alias("least")).first().least
    unranked = ["doc_id", "mark", "n_words", "n_features", "weight", "score"]
    if cut is None:
        return scores.select(*unranked, F.lit(None).cast("long").alias("rank"))
    candidate = fit & (F.col("score") >= cut)
    alike = scores.where(candidate).groupBy(*unranked).agg(F.count(F.lit(1)).alias("many")).join(held, "score")
    in_score = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight", "mark")
    up_to = F.sum("many").over(in_score.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = alike.withColumn("first", F.col("before") + up_to - F.col("many") + 1)
    each = placed.withColumn("place", F.explode(F.sequence("first", F.col("first") + F.col("many") - 1)))
    given = each.select(*unranked, F.when(F.col("place") <= F.col("wanted"), F.col("place")).alias("rank"))
    return given.unionByName(scores.where(~candidate).select(*unranked, F.lit(None).cast("long").alias("rank")))


def importance(
    docs: DataFrame,
    target: DataFrame,
    runs: int = 1,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
    id_column: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """``(doc_id, mark, n_words, n_features, weight, score, rank)`` of every document.

    ``rank`` counts the drawn ones from 1, by falling score; the others have none.
    """
    if runs not in (1, 2):
        raise ValueError("features are single words, or words and pairs: runs must be 1 or 2")
    own, other = docs.select(F.lit(0).alias("side"), F.col(text).alias("text")), target.select(F.lit(1).alias("side"), F.col(target_text).alias("text"))
    sides = own.unionByName(other)
    head = fit_head(sides, "text", runs, buckets)
    weighed = weights(docs, head, gains(totals(sides, head, runs)), id_column, text, runs)
    scores = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(materialise(scores, "resample-scores"), percent, min_words)


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn documents, whole, with their own columns.

    Rows alike in id and text stay together: all are drawn if one is.
    """
    drawn = importance(docs, target, id_column=id_column, text=text, **options).where("rank IS NOT NULL")
    keys = drawn.select(F.col("doc_id").alias("drawn_id"), F.col("mark").alias("drawn_mark")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("of"), F.xxhash64(F.col(text)).alias("mark"))
    return rows.join(keys, F.col("of").eqNullSafe(F.col("drawn_id")) & (F.col("mark") == F.col("drawn_mark")), "left_semi").select("row.*")
