"""Spelling variants: words one letter apart, found in a trie of letter counts.

Letters fall into ``GROUPS`` groups by code point, and a word becomes the vector of how many
letters of each group it has.  An inserted letter raises one count, a deleted one lowers one, a
replaced one does both or, inside a group, neither.  So the vectors of near words differ by a
surplus of at most one and a deficit of at most one.

The words are arranged as a trie by successive counts.  A search goes down the trie depth first
with a budget of one surplus and one deficit; what it spends at one count it lacks below.  The
words of the leaves it reaches are verified letter by letter.

The top of the trie is dealt out over Spark's tasks: four coarse counts (of groups of groups)
come first, with a budget of their own, as an edit shifts them by at most one as well.  A node
that holds more than ``NODE_WORDS`` words is opened and its children are dealt out instead, down
to whole vectors; words that share a whole vector are dealt in slices of that size.  A word is
stored once and searched in every node its budget reaches; nodes without words drop out in a join.
A task reports the number of near words and the best of them for each searched word, never pairs.

Words are the maximal runs of letters, A-Z lower-cased, after a seeded misspelling that deletes
one letter of some runs (``every`` sets how many; None leaves all as written).

Null and empty texts have no words; long texts are read in pieces that cut no word.  A null id
counts as the empty one in the seed; rows that repeat an id or a text count each.  Among near
words equally frequent the first in code-point order is the form.  An empty table gives no rows.
Columns of any other name are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearprint.llm import codes
from nearprint.llm.tables import buckets, materialise

EVERY = 199
MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
GROUPS = 13
COARSE = 4
#: Counts that are decided at each opening of a node: the coarse ones, then the groups in turn.
STEPS = (COARSE, 4, 4, GROUPS - 8)
#: Words of a node that one task searches; larger ones are opened.
NODE_WORDS = 20_000
#: Rows that a task is given, stored and searched.
TASK_ROWS = 1_000_000
#: Searched words that go down the trie together, and pairs that are verified together.
BATCH = 100_000
#: Longer words are verified one by one.
WIDE = 48
PIECE_CHARS = 1 << 20
TALLY = 400_000


def _letters() -> bytes:
    """Latin-1 letters as they are, A-Z in lower case, all else as space."""
    kept = np.full(256, 32, np.uint8)
    kept[97:123] = np.arange(97, 123)
    kept[65:91] = np.arange(97, 123)
    kept[0xC0:] = np.arange(0xC0, 256)
    return kept.tobytes()


_LETTERS = _letters()


def runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of letters in Latin-1, piece by piece; no run is cut."""
    held: list[bytes] = []
    for at in range(0, len(text), PIECE_CHARS):
        part = text[at : at + PIECE_CHARS].encode("latin-1", "replace").translate(_LETTERS)
        if at + PIECE_CHARS < len(text):
            end = part.rfind(b" ") + 1
            if not end:
                held.append(part)
                continue
            yield b"".join([*held, part[:end]]).split()
            held = [part[end:]]
        else:
            held.append(part)
    yield b"".join(held).split()


def misspelt(run: bytes, state: int, every: int) -> bytes:
    """The run, or the run without one letter; ``state`` is the CRC of what stands before it."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), state)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", every: int | None = EVERY, min_letters: int = MIN_LETTERS
) -> DataFrame:
    """``(word, n)``: how often each word of at least ``min_letters`` letters occurs."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many: Counter = Counter()
        for block in codes.blocks(batches):
            rows = codes.string_column(block.column("text")).cast(pa.large_binary()).to_pylist()
            for doc_id, data in zip(block.column("id").to_pylist(), rows, strict=True):
                state = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found in runs((data or b"").decode("utf-8", "replace")):
                    of = Counter([run for run in found if len(run) >= min_letters])
                    if every is None:
                        many.update(of)
                        continue
                    for run, n in of.items():
                        word = misspelt(run, state, every)
                        if len(word) >= min_letters:
                            many[word] += n
            if len(many) > TALLY:
                yield _words(many)
                many.clear()
        yield _words(many)

    chosen = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text"))
    return chosen.mapInArrow(tally, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _words(many: Counter) -> pa.RecordBatch:
    words = pa.array([w.decode("latin-1") for w in many], pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(many.values()), pa.int64())], ["word", "n"])


def _group(letter: Column) -> Column:
    return F.ascii(letter) % GROUPS


def counts(word: Column) -> Column:
    """The coarse counts, then the count of each group, as one array."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")

    def many(groups: Column) -> Column:
        coarse = F.transform(F.sequence(F.lit(0), F.lit(COARSE - 1)), lambda k: F.size(F.filter(groups, lambda g: g % COARSE == k)))
        return F.concat(coarse, F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda k: F.size(F.filter(groups, lambda g: g == k))))

    return F.get(F.transform(F.array(F.transform(letters, _group)), many), F.lit(0))


def _moves(n: int) -> list[tuple[list[int], int, int]]:
    """Changes of ``n`` counts by at most one surplus and one deficit, and what they spend."""
    out = [([0] * n, 0, 0)]
    for up in [None, *range(n)]:
        for down in [None, *range(n)]:
            if up != down:
                out.append(([(k == up) - (k == down) for k in range(n)], int(up is not None), int(down is not None)))
    return out


def _node(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ".")


def deal(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each word is stored, ``(node, word, n)``, and where it is searched, with its budget left.

    A node is a path of counts, with the number of its slice.
    """
    vector = words.select("word", "n", counts(F.col("word")).alias("vector"))
    stored, searched = vector, vector.withColumn("node", F.lit("")).withColumn("up", F.lit(1)).withColumn("down", F.lit(1))
    places: list[DataFrame] = []
    searches: list[DataFrame] = []
    depth = 0
    for step, size in enumerate(STEPS):
        start, depth, last = depth, depth + size, step == len(STEPS) - 1
        stored = stored.withColumn("node", _node(F.slice("vector", 1, depth)))
        nodes = stored.groupBy("node").agg(F.count(F.lit(1)).alias("held"))
        nodes = materialise(nodes.withColumn("large", F.lit(not last) & (F.col("held") > NODE_WORDS)), "variants-nodes")
        # A fresh budget where the coarse counts end.
        budget = [F.lit(1), F.lit(1)] if step == 1 else [F.col("up"), F.col("down")]
        moves = F.array(*[
            F.struct(F.array(*map(F.lit, change)).alias("change"), F.lit(up).alias("up"), F.lit(down).alias("down"))
            for change, up, down in _moves(size)
        ])
        open_ = searched.select("word", "n", "vector", "node", budget[0].alias("up"), budget[1].alias("down"), F.explode(moves).alias("move"))
        open_ = open_.where("move.up <= up AND move.down <= down")
        reached = _node(F.zip_with(F.slice("vector", start + 1, size), F.col("move.change"), lambda a, b: a + b))
        open_ = open_.select(
            "word", "n", "vector", F.concat("node", F.when(F.col("node") == "", "").otherwise("."), reached).alias("node"),
            (F.col("up") - F.col("move.up")).alias("up"), (F.col("down") - F.col("move.down")).alias("down"),
        ).join(nodes, "node")
        stored = stored.join(nodes, "node")
        slices = F.ceil(F.col("held") / NODE_WORDS).cast("int") if last else F.lit(1)
        slice_of = F.pmod(F.xxhash64("word"), slices).cast("string")
        places.append(stored.where("NOT large").select(F.concat("node", F.lit("/"), slice_of).alias("node"), "word", "n"))
        each = open_.where("NOT large").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        # Inside a task all groups are searched: those the path has settled are met once more.
        searches.append(each.select(F.concat("node", F.lit("/"), F.col("slice").cast("string")).alias("node"), "word", "n"))
        if last or not nodes.where("large").limit(1).count():
            break
        stored = stored.where("large").select("word", "n", "vector")
        searched = open_.where("large").select("word", "n", "vector", "node", "up", "down")
    return _union(places), _union(searches)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class Spelled:
    """Words as arrays of letters: group counts, letters from either end, lengths."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        width = WIDE
        self.left = np.zeros((len(words), width), np.uint8)
        self.right = np.zeros((len(words), width), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(len(words)), self.length)
        start = np.cumsum(self.length) - self.length
        at = np.arange(len(flat)) - start[row]
        self.groups = np.bincount(row * GROUPS + flat % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)
        fits = at < width
        self.left[row[fits], at[fits]] = flat[fits]
        back = self.length[row] - 1 - at
        fits = back < width
        self.right[row[fits], back[fits]] = flat[fits]


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def verify(a: Spelled, i: np.ndarray, b: Spelled, j: np.ndarray) -> np.ndarray:
    """For pairs of words, whether they are one letter apart."""
    la, lb = a.length[i], b.length[j]
    width = min(a.left.shape[1], b.left.shape[1])
    out = np.zeros(len(i), bool)
    wide = (np.maximum(la, lb) > width) & (np.abs(la - lb) <= 1)
    short = np.flatnonzero(~wide & (np.abs(la - lb) <= 1))
    si, sj = i[short], j[short]
    other = a.left[si, :width] != b.left[sj, :width]
    same = la[short] == lb[short]
    prefix = np.where(other.any(axis=1), other.argmax(axis=1), width)
    far = a.right[si, :width] != b.right[sj, :width]
    suffix = np.where(far.any(axis=1), far.argmax(axis=1), width)
    out[short] = np.where(same, other.sum(axis=1) == 1, prefix + suffix >= np.minimum(la[short], lb[short]))
    for k in np.flatnonzero(wide).tolist():
        out[k] = one_apart(a.words[i[k]], b.words[j[k]])
    return out


class Trie:
    """Words below some nodes, by successive group counts; level 0 is the node."""

    def __init__(self, spelled: Spelled, node: np.ndarray, nodes: int):
        order = np.lexsort([*spelled.groups.T[::-1], node])
        self.words = order
        keys = np.column_stack([node[order], spelled.groups[order]])
        new = np.ones(len(order), bool)
        self.base = int(spelled.groups.max(initial=0)) + 3
        self.levels = []
        if len(order):
            new[1:] = keys[1:, 0] != keys[:-1, 0]
        place = np.cumsum(new) - 1
        self.roots = np.full(nodes, -1, np.int64)
        self.roots[keys[new, 0]] = place[new]
        for k in range(GROUPS):
            parent = place
            new = new.copy()
            new[1:] |= keys[1:, k + 1] != keys[:-1, k + 1]
            place = np.cumsum(new) - 1
            self.levels.append(parent[new] * self.base + keys[new, k + 1])
        self.start = np.append(np.flatnonzero(new), len(order))

    def search(self, groups: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Searched words with the leaves they reach, depth first."""
        at = self.roots[node]
        open_ = [(0, 1, 1, np.flatnonzero(at >= 0), at[at >= 0])]
        while open_:
            depth, up, down, of, place = open_.pop()
            if depth == GROUPS:
                yield of, place
                continue
            level = self.levels[depth]
            for change in (0, 1, -1):
                if change > up or -change > down:
                    continue
                count = groups[of, depth] + change
                code = place * self.base + count
                child = np.minimum(np.searchsorted(level, code), len(level) - 1)
                hit = (level[child] == code) & (count >= 0) & (count < self.base)
                if hit.any():
                    open_.append((depth + 1, up - (change > 0), down - (change < 0), of[hit], child[hit]))


def _pairs(start: np.ndarray, of: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Searched word and place of a stored one, ``BATCH`` pairs at a time or those of one leaf."""
    many = start[leaf + 1] - start[leaf]
    ends = np.cumsum(many)
    at = 0
    while at < len(of):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + BATCH, "right")))
        n = many[at:end]
        first = np.cumsum(n) - n
        yield np.repeat(of[at:end], n), np.arange(n.sum()) - np.repeat(first, n) + np.repeat(start[leaf[at:end]], n)
        at = end


FOUND = "word string, n_near bigint, near_n bigint, near string"


def _searched(table: pa.Table) -> Iterator[pa.RecordBatch]:
    node_column = table.column("node").combine_chunks().dictionary_encode()
    node, nodes = node_column.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(node_column.dictionary)
    stored = table.column("stored").to_numpy(zero_copy_only=False).astype(bool)
    n = table.column("n").to_numpy(zero_copy_only=False)
    text = table.column("word").combine_chunks()
    here, there = np.flatnonzero(stored), np.flatnonzero(~stored)
    held = Spelled([w.encode("latin-1") for w in text.take(pa.array(here)).to_pylist()])
    trie = Trie(held, node[here], nodes)
    held_n = n[here]
    rank = np.empty(len(here), np.int64)
    rank[sorted(range(len(here)), key=held.words.__getitem__)] = np.arange(len(here))
    for at in range(0, len(there), BATCH):
        batch = there[at : at + BATCH]
        names = text.take(pa.array(batch))
        asked = Spelled([w.encode("latin-1") for w in names.to_pylist()])
        many = np.zeros(len(batch), np.int64)
        best = np.full(len(batch), -1, np.int64)
        for of, leaf in trie.search(asked.groups, node[batch]):
            for i, place in _pairs(trie.start, of, leaf):
                j = trie.words[place]
                near = verify(asked, i, held, j)
                i, j = i[near], j[near]
                many += np.bincount(i, minlength=len(batch))
                asked_again = np.unique(i[best[i] >= 0])
                i, j = np.concatenate([i, asked_again]), np.concatenate([j, best[asked_again]])
                order = np.lexsort([rank[j], -held_n[j], i])
                top = order[np.append(True, i[order][1:] != i[order][:-1])] if len(order) else order
                best[i[top]] = j[top]
        found = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(found)), pa.array(many[found]), pa.array(held_n[best[found]]),
                pa.array([held.words[k].decode("latin-1") for k in best[found].tolist()], pa.string()),
            ],
            ["word", "n_near", "near_n", "near"],
        )


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, near_n, near)`` of every word that has a near one, for a written ``(word, n)`` table."""
    spark = words.sparkSession
    places, searches = deal(words)
    rows = places.select("node", "word", "n", F.lit(True).alias("stored")).unionByName(searches.select("node", "word", "n", F.lit(False).alias("stored")))
    tasks = max(buckets(spark), math.ceil(words.count() * len(_moves(COARSE)) / TASK_ROWS))
    found = rows.repartition(tasks, "node").mapInArrow(_in_task, FOUND)
    # The most frequent near word, the first in code-point order of several.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def _in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield from _searched(pa.Table.from_batches(held))


def roots(forms: DataFrame, most: int, ratio: int = RATIO, least: int = MIN_COUNT) -> DataFrame:
    """``(word, root)`` for ``(word, form)`` rows: where the forms lead.

    Each form is ``ratio`` times as frequent as its word, so a path has no loop and at most
    ``log(most / least, ratio)`` steps; each round doubles the steps that are taken.
    """
    steps = math.floor(math.log(max(1, most / least), ratio) + 1e-9)
    at = materialise(forms.select("word", F.col("form").alias("root")), "variants-roots")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = at.select(F.col("word").alias("passed"), F.col("root").alias("beyond"))
        joined = at.join(onward, F.col("root") == F.col("passed"), "left")
        at = materialise(joined.select("word", F.coalesce("beyond", "root").alias("root")), "variants-roots")
    return at


def group(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    every: int | None = EVERY,
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word that occurs ``min_count`` times."""
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word: ratio must be 2 or more")
    words = materialise(count_words(docs, id_column, text, every, min_letters).where(F.col("n") >= min_count), "variants-words")
    found = near_words(words).withColumnRenamed("word", "of")
    fits = F.col("near_n") >= ratio * F.col("n")
    rows = words.join(found, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"),
    )
    rows = materialise(rows, "variants-forms")
    most = words.agg(F.max("n")).first()[0]
    led = roots(rows.where("form IS NOT NULL").select("word", "form"), most or 0, ratio, min_count).withColumnRenamed("word", "of")
    return rows.join(led, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
