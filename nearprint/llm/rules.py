"""Quality rules: counts of words, signs and repetitions, and n-gram perplexity.

The language model is a modified Kneser-Ney model of the code points of a text, ``ORDER`` at a
time, one for each language name.  Digits count as one sign, and so does white space; all else
stays as it is.  Spark gathers the n-grams and reckons counts, discounts and back-off weights by
grouping and joining, so the model grows with what the corpus holds.  The longest n-grams are counted
by occurrences, shorter ones by the number of code points they follow.  Texts that are equal are one
text of the corpus: otherwise those that come in thousands of copies would make the language.  N-grams
of three code points or more with a count of one are left out, as a text would otherwise be likely for
being its own model; what they held goes to the shorter ones.

The model is a stored table of n-gram hashes, in sorted runs by range of the hash, with the log
probability of each n-gram and the weight with which it backs off as a context.  Up to
``SENT_ROWS`` rows it is sent to every executor.  Beyond that the texts are dealt into parts of
some MiB, each asks the table for its distinct n-grams, and is scored with the answers.  Both ways
give the same losses.

A document's mean negative log probability is drawn towards the median of its language as if
it had ``PRIOR_CHARS`` more characters, since short texts vary more.  Documents outside the
band of their language are rejected: above it noise, below it text that repeats itself.
The band is the median and ``REACH`` times the median absolute deviation to either side, both
over all documents of the language that pass the base rules, so that noise moves neither much
as long as it is well under half of them.  Where most texts are copies the deviation is close to
0; it counts as ``LEAST`` of the median at least.

Null and empty texts have no n-gram, no word and fail the base rules; a text longer than a block is
a block of its own.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearprint.llm import codes
from nearprint.llm.lines import Lines
from nearprint.llm.tables import materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
ORDER = 4
#: N-grams of so many code points and more are left out if they follow one code point only.
PRUNED = 3
#: Rows of a model that is sent to every executor, 16 bytes each.
SENT_ROWS = 2_000_000
#: Slots in which repeated runs of a block are found, as a power of 2.
SLOT_BITS = 20
#: Distinct runs a task holds before it hands them on.
HELD_RUNS = 1_000_000
#: Blocks of text in a part, where the model is not sent.
PART_BLOCKS = 8
#: What a language that the model does not hold gives each code point.
UNKNOWN = -float(np.log(0x110000))
PRIOR_CHARS = 300
#: Width of a band in median absolute deviations.  On sf0.1, planted random characters lie 58 or
#: more of them above the median where they are 13 % of a language, 21 where they are 37 %.
REACH = 15.0
LEAST = 0.01

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[48:58] = ord("0")
_FOLDED[codes.SPACE] = ord(" ")


def name_of(lang: str) -> Column:
    """The language as a name that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(""))


def seeds(names: pa.Array) -> np.ndarray:
    """A number of 64 bits for the language of each row."""
    column = codes.string_column(names).dictionary_encode()
    table = [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in column.dictionary.to_pylist()]
    return np.array(table, np.uint64)[column.indices.to_numpy(zero_copy_only=False)] if table else np.zeros(len(column), np.uint64)


class Grams:
    """The runs of ``length`` code points of a block, and the text each is in."""

    def __init__(self, block: pa.RecordBatch, length: int = ORDER):
        self.length = length
        raw, self.places = codes.flat(block.column("text"))
        self.buf = _FOLDED[raw]
        self.sums = codes.rolling(self.buf)
        self.at = np.append(np.flatnonzero((self.buf & 0xC0) != 0x80), len(self.buf))
        points = np.diff(np.searchsorted(self.at[:-1], self.places))
        text = np.repeat(np.arange(len(points)), points)
        m = max(0, len(text) - length + 1)
        self.first = np.flatnonzero(text[:m] == text[len(text) - m :])
        self.text = text[self.first]
        self.seed = seeds(block.column("name"))

    def ends(self, some: np.ndarray, skip: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        start = self.first[some] + skip
        return self.at[start], self.at[start + n]

    def hashes(self, some: np.ndarray, skip: int, n: int) -> np.ndarray:
        """Of the n-grams ``some``, the ``n`` code points after the first ``skip``."""
        return codes.spans_hash(self.sums, *self.ends(some, skip, n)) ^ self.seed[self.text[some]]

    def everything(self) -> np.ndarray:
        return np.arange(len(self.first))

    def strings(self, some: np.ndarray) -> pa.Array:
        starts, ends = self.ends(some, 0, self.length)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
        buffers = [pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.buf[take])]
        return pa.StringArray.from_buffers(len(some), *buffers)


GATHERED = "name string, gram string, many bigint"


def _gather(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The distinct runs of ``length`` code points of a task, or of as much of it as fits ``HELD_RUNS``, and how often each occurs."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for block in codes.blocks(batches):
            runs = Grams(block, length)
            h, some, many = _occurring(runs.hashes(runs.everything(), 0, length))
            if held and len(held[0][0]):
                known, _, _, times = held[0]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                old = known[at] == h
                times[at[old]] += many[old]
                h, some, many = h[~old], some[~old], many[~old]
            names = codes.string_column(block.column("name")).dictionary_encode().cast(pa.string())
            held.append((h, names.take(pa.array(runs.text[some])), runs.strings(some), many))
            rows += len(h)
            if len(held) == 8 or rows > HELD_RUNS:
                held = [_merged(held)]
                rows = len(held[0][0])
            if rows > HELD_RUNS:
                yield _rows_of(held.pop())
                rows = 0
        if held:
            yield _rows_of(_merged(held))

    return gather


def _rows_of(part: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([part[1], part[2], pa.array(part[3])], ["name", "gram", "many"])


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and a place of each."""
    return _occurring(h)[:2]


def _occurring(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, a place of each, and how often it occurs.

    Most repeat: each hash writes its place into a slot, and one that reads its own hash at the
    place of another is counted there and left out before the rest are sorted.
    """
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    last = np.empty(1 << SLOT_BITS, np.int32)
    places = np.arange(len(h), dtype=np.int32)
    last[slot] = places
    there = last[slot]
    times = np.bincount(np.where(h[there] == h, there, places), minlength=len(h))
    left = np.flatnonzero(times)
    distinct, first, of = np.unique(h[left], return_index=True, return_inverse=True)
    return distinct, left[first], _summed(of, times[left], len(distinct))


def _summed(of: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, weights=many, minlength=n).astype(np.int64)


def _merged(parts: list) -> tuple:
    h, some, of = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    names, grams = (pa.concat_arrays([p[k] for p in parts]).take(pa.array(some)) for k in (1, 2))
    return h, names, grams, _summed(of, np.concatenate([p[3] for p in parts]), len(h))


def _discounts(level: DataFrame) -> DataFrame:
    """``(name, d1, d2, d3)``: discounts for counts of 1, 2, and 3 or more, from the counts of counts."""
    of = level.groupBy("name").agg(*[F.greatest(F.count_if(F.col("many") == k), F.lit(1)).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    taken = [k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}") for k in (1, 2, 3)]
    # At least a tenth is taken, so that something is left for what was not seen.
    return of.select("name", *[F.greatest(F.lit(0.1), F.least(F.lit(float(k)), d)).alias(f"d{k}") for k, d in enumerate(taken, 1)])


def probabilities(runs: DataFrame, order: int = ORDER, pruned: int = PRUNED, occurrences: bool = False) -> DataFrame:
    """``(name, gram, logp, off)`` from the distinct runs ``(name, gram)`` of ``order + 1`` code points.

    With ``occurrences`` from the distinct runs ``(name, gram, many)`` of ``order`` code points and
    how often each occurs, which are the counts of the longest n-grams then.

    ``gram`` has up to ``order`` code points; ``logp`` is null for one that is only a context, and
    ``off`` is the log of the weight with which it backs off.  The empty gram has the log
    probability of a code point that was not seen.
    """
    longest = order if occurrences else order + 1
    levels = {longest: runs}
    for n in range(longest - 1, 0, -1):
        shorter = levels[n + 1].groupBy("name", F.expr(f"substring(gram, 2, {n})").alias("gram"))
        levels[n] = materialise(shorter.agg(F.count("*").alias("many")), "rules-level")
    parts, known = [], None
    for n in range(1, order + 1):
        least = 2 if n >= pruned else 1
        level = levels[n].join(_discounts(levels[n]), "name")
        taken = F.when(F.col("many") == 1, F.col("d1")).when(F.col("many") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.select(
            "name", "gram", "many", F.expr(f"substring(gram, 1, {n - 1})").alias("context"), F.expr(f"substring(gram, 2, {n - 1})").alias("rest"),
            F.when(F.col("many") >= least, F.col("many") - taken).otherwise(F.lit(0.0)).alias("left"), "d1", "d2", "d3",
        )
        # Whole numbers are summed, so that no order of rows shows in the weights.
        whole = F.sum(F.when(F.col("many") >= least, F.col("many")).otherwise(0))
        cut = sum(F.count_if((F.col("many") == k) & (F.col("many") >= least)) * F.first(f"d{k}") for k in (1, 2)) + F.count_if(F.col("many") > 2) * F.first("d3")
        contexts = level.groupBy("name", "context").agg(F.sum("many").alias("total"), (1 - (whole - cut) / F.sum("many")).alias("weight"), F.count("*").alias("kinds"))
        contexts = materialise(contexts, "rules-contexts")
        if n == 1:
            lower = contexts.select("name", F.lit("").alias("rest"), (1 / (F.col("kinds") + 1)).alias("below"))
            unseen = contexts.select("name", F.lit("").alias("gram"), F.log(F.col("weight") / (F.col("kinds") + 1)).alias("logp"), F.lit(0.0).alias("off"))
            parts.append(unseen)
        else:
            lower = known.select("name", F.col("gram").alias("rest"), F.col("p").alias("below"))
            offs = contexts.select("name", F.col("context").alias("gram"), F.log("weight").alias("off"))
            seen = known.where(F.col("many") >= (2 if n - 1 >= pruned else 1)).select("name", "gram", F.log("p").alias("logp"))
            parts.append(seen.join(offs, ["name", "gram"], "full").select("name", "gram", "logp", F.coalesce("off", F.lit(0.0)).alias("off")))
        p = F.col("left") / F.col("total") + F.col("weight") * F.col("below")
        known = materialise(level.join(contexts, ["name", "context"]).join(lower, ["name", "rest"]).select("name", "gram", "many", p.alias("p")), "rules-known")
    top = known.where(F.col("many") >= (2 if order >= pruned else 1))
    parts.append(top.select("name", "gram", F.log("p").alias("logp"), F.lit(0.0).alias("off")))
    return reduce(DataFrame.unionByName, parts)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, places = codes.flat(batch.column("gram"))
        h = codes.spans_hash(codes.rolling(buf), places[:-1], places[1:]) ^ seeds(batch.column("name"))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(batch.column(c).cast(pa.float32()) for c in ("logp", "off"))], ["hash", "logp", "off"])


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", occurrences: bool = False) -> DataFrame:
    """The stored model ``(hash, logp, off)`` of all documents, sorted within ranges of the hash.

    With ``occurrences`` the longest n-grams are counted by how often they occur in the distinct
    texts of a language, as modified Kneser-Ney has it; without, by the code points they follow.
    """
    named = docs.select(F.col(text).alias("text"), name_of(lang).alias("name"))
    if occurrences:
        counts = named.distinct().mapInArrow(_gather(ORDER), GATHERED).groupBy("name", "gram").agg(F.sum("many").alias("many"))
        grams = probabilities(materialise(counts, "rules-level"), occurrences=True)
    else:
        grams = probabilities(named.mapInArrow(_gather(ORDER + 1), GATHERED).select("name", "gram").distinct())
    hashed = grams.mapInArrow(_hashed, "hash bigint, logp float, off float")
    return materialise(hashed.repartitionByRange("hash").sortWithinPartitions("hash"), "rules-model")


@dataclass(frozen=True)
class Table:
    """Rows of the model as arrays, sorted by hash."""

    hash: np.ndarray
    logp: np.ndarray
    off: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Table:
        h = rows.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(h)
        return cls(h[order], *(rows.column(c).cast(pa.float32()).to_numpy()[order] for c in ("logp", "off")))

    @cached_property
    def index(self) -> tuple[np.ndarray, np.uint64]:
        """The first row of each range of hashes, about one row to a range, and how far to shift a hash."""
        bits = max(1, len(self.hash).bit_length())
        shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << shift
        return np.append(np.searchsorted(self.hash, edges), len(self.hash)).astype(np.int32), shift

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        if not len(self.hash):
            return np.full(len(wanted), -1)
        first, shift = self.index
        of = (wanted >> shift).astype(np.int64)
        row, end = first[of], first[of + 1]
        out = np.where((row < end) & (self.hash[np.minimum(row, len(self.hash) - 1)] == wanted), row, -1)
        # The few that share their range with other rows.
        open_ = np.flatnonzero((out < 0) & (row + 1 < end))
        row = row[open_] + 1
        while len(open_):
            hit = self.hash[row] == wanted[open_]
            out[open_[hit]] = row[hit]
            more = ~hit & (row + 1 < end[open_])
            open_, row = open_[more], row[more] + 1
        return out

    def losses(self, grams: Grams, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of n-grams of each of ``n`` texts, and their summed negative log probability."""
        out = np.zeros(len(grams.first))
        open_ = grams.everything()
        for k in range(ORDER, -1, -1):
            row = self.find(grams.hashes(open_, ORDER - k, k))
            value = np.where(row >= 0, self.logp[row], np.float32("nan")) if len(self.hash) else np.full(len(row), np.float32("nan"))
            seen = ~np.isnan(value)
            out[open_[seen]] += value[seen]
            open_ = open_[~seen]
            if not len(open_):
                break
            if k > 1:
                context = self.find(grams.hashes(open_, ORDER - k, k - 1))
                out[open_] += np.where(context >= 0, self.off[context], np.float32(0)) if len(self.hash) else 0.0
            elif k == 0:
                out[open_] += UNKNOWN
        return np.bincount(grams.text, minlength=n), np.round(np.bincount(grams.text, weights=-out, minlength=n), 4)


def base_counts(buf: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
    n = len(places) - 1
    words = codes.Words(buf, places)
    chars = codes.char_counts(buf)
    length = (chars[words.end] - chars[words.start]).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
    lines = Lines(buf, places)
    full = np.flatnonzero(lines.full)
    order = full[np.lexsort((full, lines.hash[full], lines.text[full]))]
    twice = (lines.hash[order][1:] == lines.hash[order][:-1]) & (lines.text[order][1:] == lines.text[order][:-1])
    h = words.hashes(codes.rolling(buf)) if n and len(buf) else np.zeros(0, np.uint64)
    grams = codes.word_grams(h, 3)
    at = np.flatnonzero(words.text[: len(grams)] == words.text[2:]) if len(grams) else np.zeros(0, np.int64)
    by = at[np.lexsort((grams[at], words.text[at]))]
    same = (grams[by][1:] == grams[by][:-1]) & (words.text[by][1:] == words.text[by][:-1])
    again = by[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(by) else by
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + 3, -1)
    repeat = np.cumsum(edge)[:-1] > 0
    return {
        "n_words": words.counts, "word_chars": np.bincount(words.text, weights=length, minlength=n), "n_symbols": symbols[places[1:]] - symbols[places[:-1]],
        "n_dup_lines": np.bincount(lines.text[order[1:][twice]], minlength=n), "n_repeat_words": np.bincount(words.text[repeat], minlength=n),
    }


SCORED = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_grams bigint, loss double"


def _scored(block: pa.RecordBatch, table: Table) -> pa.RecordBatch:
    base = base_counts(*codes.flat(block.column("text")))
    n_grams, loss = table.losses(Grams(block), block.num_rows)
    columns = [block.column("doc_id"), block.column("lang"), *(pa.array(v.astype(np.int64)) for v in base.values())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n_grams), pa.array(loss)], [f.split()[0] for f in SCORED.split(", ")])


def scores(docs: DataFrame, model: DataFrame, id_column: str = "doc_id", lang: str = "lang", text: str = "text", sent_rows: int = SENT_ROWS) -> DataFrame:
    """The base counts, the number of n-grams, and their summed negative log probability."""
    chosen = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), name_of(lang).alias("name"), F.col(text).alias("text")
    )
    if model.count() > sent_rows:
        return _scored_by_parts(chosen, model)
    table = Table.of(model.toArrow())
    # Plain arrays: a broadcast is read where this package need not be installed.
    shared = docs.sparkSession.sparkContext.broadcast((table.hash, table.logp, table.off))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Table(*shared.value)
        for block in codes.blocks(batches):
            yield _scored(block, known)

    return chosen.mapInArrow(score, SCORED)


def _scored_by_parts(chosen: DataFrame, model: DataFrame) -> DataFrame:
    """The same for a model of any size: each part of the texts asks for its distinct n-grams."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, block in enumerate(codes.blocks(batches)):
            yield block.append_column("part", pa.array(np.full(block.num_rows, task + k // PART_BLOCKS)))

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        wanted = []
        for block in codes.blocks(rows.combine_chunks().to_batches()):
            grams = Grams(block)
            every = grams.everything()
            # Contexts are the shorter n-grams but for the place they are taken from.
            spans = {(ORDER - k, k) for k in range(ORDER + 1)} | {(ORDER - k, k - 1) for k in range(2, ORDER + 1)}
            wanted.append(np.unique(np.concatenate([np.unique(grams.hashes(every, *span)) for span in spans])))
        h = np.unique(np.concatenate(wanted)).view(np.int64)
        return pa.table({"part": pa.array(np.full(len(h), key[0].as_py())), "hash": pa.array(h)})

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        table = Table.of(answers)
        return pa.Table.from_batches([_scored(block, table) for block in codes.blocks(texts.combine_chunks().to_batches())])

    dealt = materialise(chosen.mapInArrow(deal, "doc_id bigint, lang string, name string, text string, part bigint"), "rules-parts")
    asked = dealt.groupBy("part").applyInArrow(ask, "part bigint, hash bigint")
    answers = asked.join(model, "hash").select("part", "hash", "logp", "off")
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(score, SCORED)


def apply(docs: DataFrame, id_column: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """The base counts, ``base_failed``, the loss a character, its language's band, and ``kept``.

    Null texts count as empty.  A null language is a language of its own.  Each row is
    judged for itself, whether its id is null or repeated.
    """
    rows = materialise(scores(docs, fit(docs, lang, text, occurrences=True), id_column, lang, text), "rules")
    # Rounded to three places, a language has some thousand values: percentiles are exact and small.
    mean = F.round(F.col("loss") / F.greatest(F.col("n_grams"), F.lit(1)), 3)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    judged = rows.where(~F.col("base_failed"))
    middle = judged.groupBy(F.col("lang").alias("of")).agg(F.percentile(mean, 0.5).alias("median"))
    drawn = lambda df: df.join(middle, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of").withColumn(
        "loss_per_char", F.round((F.col("loss") + PRIOR_CHARS * F.col("median")) / (F.col("n_grams") + PRIOR_CHARS), 3)
    )
    ends = drawn(judged).groupBy(F.col("lang").alias("of")).agg(F.percentile("loss_per_char", 0.5).alias("mid"))
    apart = drawn(judged).join(ends, F.col("lang").eqNullSafe(F.col("of"))).withColumn("apart", F.round(F.abs(F.col("loss_per_char") - F.col("mid")), 4))
    spread = apart.groupBy("of").agg(F.first("mid").alias("mid"), F.percentile("apart", 0.5).alias("mad"))
    reach = REACH * F.greatest("mad", LEAST * F.col("mid"))
    bands = spread.select("of", (F.col("mid") - reach).alias("band_low"), (F.col("mid") + reach).alias("band_high"))
    joined = drawn(rows).join(bands, F.col("lang").eqNullSafe(F.col("of")), "left")
    inside = (F.col("loss_per_char") >= F.col("band_low")) & (F.col("loss_per_char") <= F.col("band_high"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "lang", "loss_per_char", "band_low", "band_high",
    )
