"""Quality by importance resampling.

Two generative models give the probability of a text as a bag of hashed n-grams: one of
target text (documents labelled good), one of all raw text.  The log of their ratio is the
weight of a document.  Documents are drawn without replacement by Gumbel top-k: each
weight gets seeded Gumbel noise, and the ``k`` largest sums stay.

N-grams are single words, pairs of words, and shapes of both.  A shape is how a word begins
and ends (small or capital letter, digit, sign, other script), its length, and whether it
repeats the word before or the one before that; shapes speak where a vocabulary is so open
that words do not.  Each kind has its own cells.  Both models are smoothed at the size of
the target sample, so that a cell the sample could hardly have held changes no weight.

What is bounded, and by what: the target model reads at most ``LABELLED`` labelled rows,
those of smallest id hash; the models are two arrays of ``CELLS`` counts.  The counts of raw
text, the weights and the cut run over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearprint.llm import codes
from nearprint.llm.mixing import draw
from nearprint.llm.tables import materialise, own_names

LABELLED = 20_000
#: Cells of each kind of n-gram: words, pairs of words, shapes.
KIND_CELLS = 1 << 16
CELLS = 3 * KIND_CELLS
SEGMENTS = 64
SEED = "quality-1"
#: Scale of the Gumbel noise, in units of log weight: 1 draws in proportion to the ratio.
TEMPERATURE = 1.0
#: Added to each cell of both models, the raw one scaled to the size of the target sample.
SMOOTHING = 4.0

_SHAPE = np.zeros(256, np.uint64)
_SHAPE[97:123] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_SHAPE[128:] = 4
for _at, _sign in enumerate(b".,;:!?'\"()[]{}<>|#*$%&@/\\+-=_~^`"):
    _SHAPE[_sign] = 5 + _at


def features(buf: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all n-grams of a block, and the text each belongs to."""
    words = codes.Words(buf, places)
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = words.hashes(codes.rolling(buf))
    shape = _SHAPE[buf[words.start]] << np.uint64(8) | _SHAPE[buf[words.end - 1]]
    length = np.minimum(words.end - words.start, 15).astype(np.uint64)
    again = np.zeros(len(h), np.uint64)
    again[1:] |= ((h[1:] == h[:-1]) & (words.text[1:] == words.text[:-1])).astype(np.uint64)
    again[2:] |= ((h[2:] == h[:-2]) & (words.text[2:] == words.text[:-2])).astype(np.uint64) << np.uint64(1)
    shape = shape << np.uint64(8) | length << np.uint64(2) | again
    pair = words.text[1:] == words.text[:-1]
    shapes = shape[1:][pair] << np.uint64(24) | shape[:-1][pair]
    second = words.text[1:][pair]
    kinds = (
        (0, h, words.text),
        (1, codes.word_grams(h, 2)[pair], second),
        (2, shape + np.uint64(7 << 40), words.text),
        (2, shapes + np.uint64(11 << 52), second),
    )
    cells = [(codes.mix(gram) % np.uint64(KIND_CELLS)).astype(np.int64) + kind * KIND_CELLS for kind, gram, _ in kinds]
    return np.concatenate(cells), np.concatenate([texts for _, _, texts in kinds])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    for block in codes.blocks(batches):
        cells, texts = features(*codes.flat(block.column("text")))
        good = block.column("good").to_numpy(zero_copy_only=False).astype(bool)
        raw += np.bincount(cells, minlength=CELLS)
        target += np.bincount(cells[good[texts]], minlength=CELLS)
    if raw.any():
        pieces = [np.concatenate([a, b]).tolist() for a, b in zip(np.split(raw, SEGMENTS), np.split(target, SEGMENTS), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SEGMENTS), pa.int32()), pa.array(pieces, pa.list_(pa.int64()))], ["segment", "counts"]
        )


def _add(pieces: pa.Table) -> pa.Table:
    counts = pieces.column("counts").combine_chunks().flatten().to_numpy()
    total = counts.reshape(pieces.num_rows, -1).sum(axis=0)
    return pa.table({"segment": pieces.column("segment").slice(0, 1), "counts": pa.array([total.tolist()], pa.list_(pa.int64()))})


@dataclass(frozen=True)
class Model:
    """``ratio`` per cell, and the weight from which a document counts as good."""

    ratio: np.ndarray
    cutoff: float

    def weights(self, column: pa.Array) -> np.ndarray:
        """The log weight of each text; 0 for texts without an n-gram."""
        buf, places = codes.flat(column)
        cells, texts = features(buf, places)
        out = np.bincount(texts, weights=self.ratio[cells], minlength=len(places) - 1)
        return np.round(out, 6)


def labelled(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """``(doc_id, good)`` of at most ``bound`` labelled documents, those of smallest id hash."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ordered = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return ordered.select("doc_id", (F.col("quality") == 1).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    """The two models and the cutoff that best separates the labelled documents.

    Without any good label nothing is known of the target: all ratios are 0.
    """
    sample = materialise(labelled(labels, bound), "quality-labels")
    known = F.broadcast(sample)  # at most ``bound`` rows of an id and a flag
    read = docs.select("doc_id", "text").join(known, "doc_id", "left")
    flagged = read.select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counted = flagged.mapInArrow(_count, "segment int, counts array<bigint>")
    added = counted.groupBy("segment").applyInArrow(_add, "segment int, counts array<bigint>").collect()
    raw, target = np.zeros(CELLS), np.zeros(CELLS)
    width = CELLS // SEGMENTS
    for segment, counts in added:
        raw[segment * width : (segment + 1) * width] = counts[:width]
        target[segment * width : (segment + 1) * width] = counts[width:]
    if not target.any():
        return Model(np.zeros(CELLS), 0.0)
    ratio = log_ratio(raw, target)
    model = Model(ratio, 0.0)
    judged = docs.select("doc_id", "text").join(known, "doc_id").select("doc_id", "text", "good")
    rows = weigh(judged, model, ["good"]).select("good", "weight").collect()  # the labelled sample only
    return Model(ratio, best_cutoff(np.array([r[1] for r in rows]), np.array([r[0] for r in rows], bool)))


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log of target over raw probability per cell, each kind of n-gram a model of its own."""
    out = []
    for whole, some in zip(np.split(raw, 3), np.split(target, 3), strict=True):
        expected = whole * (some.sum() / max(whole.sum(), 1.0))
        out.append(np.log(some + SMOOTHING) - np.log(expected + SMOOTHING))
    return np.concatenate(out)


def best_cutoff(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight from which on most is right, good and bad rows counting alike as groups."""
    if not len(weights) or good.all() or not good.any():
        return float("-inf") if good.any() else 0.0
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    caught = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    value = caught - lost
    value[1:-1][weights[1:] == weights[:-1]] = -1  # no cut between equal weights
    at = np.flatnonzero(value == value.max())
    # Of the best places the one in the middle of the widest gap.
    edges = np.concatenate([[weights[0] - 1], weights, [weights[-1] + 1]])
    widest = at[np.argmax(edges[at + 1] - edges[at])]
    return float((edges[widest] + edges[widest + 1]) / 2)


def weigh(docs: DataFrame, model: Model, keep: list[str], name: str = "weight") -> DataFrame:
    """The columns ``keep`` and the log weight of every document, under ``name``."""
    # Plain values: a broadcast is read where this package need not be installed.
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.cutoff))
    (weighed,) = own_names(docs, "weighed_text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for block in codes.blocks(batches, weighed):
            weights = pa.array(known.weights(block.column(weighed)))
            columns = [block.column(c) for c in keep] + [weights]
            yield pa.RecordBatch.from_arrays(columns, [*keep, name])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"{name} double"])
    return docs.select(*keep, F.col("text").alias(weighed)).mapInArrow(score, schema)


def noisy(weight: str = "weight", seed: str = SEED, temperature: float = TEMPERATURE):
    """The key of Gumbel top-k: weight plus noise drawn from the id."""
    uniform = (draw(F.col("doc_id"), seed) + 0.5) / float(1 << 32)
    return F.col(weight) - F.lit(temperature) * F.log(-F.log(uniform))


def threshold(keys: DataFrame, k: int, key: str = "key", enough: int = 10_000) -> float:
    """The ``k``-th largest key, found by histograms that close in on it.

    The driver sees at most 1,024 counts at a time and, at the end, ``enough`` keys.
    """
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n or low == high:
        return float("-inf") if k >= n else low
    if k <= 0:
        return float("inf")
    left = k
    while True:
        inside = keys.where((F.col(key) >= low) & (F.col(key) <= high))
        size = inside.count()
        if size <= enough or low == high:
            found = [r[0] for r in inside.select(key).orderBy(F.col(key).desc()).limit(min(left, enough)).collect()]
            return found[-1]
        step = (high - low) / 1024
        at = F.least(F.floor((F.col(key) - low) / F.lit(step)), F.lit(1023))
        counts = inside.groupBy(at.alias("at")).agg(F.count("*"), F.min(key), F.max(key)).orderBy(F.col("at").desc()).collect()
        for _, count, smallest, largest in counts:
            if left <= count:
                low, high = smallest, largest
                break
            left -= count


def select(docs: DataFrame, model: Model, k: int | None = None, temperature: float = TEMPERATURE, seed: str = SEED) -> tuple[DataFrame, float]:
    """``(doc_id, weight, key)`` of all documents, and the key from which on they are drawn.

    ``k`` is by default the number of documents that weigh at least the model's cutoff.
    Null and empty texts weigh 0; null ids share one draw of noise; rows that repeat an id
    are judged each by its own text.  Equal keys at the cut are all drawn.
    """
    keys = weigh(docs, model, ["doc_id"]).withColumn("key", noisy("weight", seed, temperature))
    keys = materialise(keys, "quality-keys")
    if k is None:
        k = keys.where(F.col("weight") >= model.cutoff).count()
    return keys, threshold(keys, k)


def keep_good(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """The rows of the documents drawn, with their own columns; nothing is shuffled."""
    model = fit(docs, labels)
    _, cut = select(docs, model, None, temperature, seed)
    (name,) = own_names(docs, "weight")
    weighed = weigh(docs, model, docs.columns, name)
    return weighed.where(noisy(name, seed, temperature) >= cut).select(*docs.columns)
