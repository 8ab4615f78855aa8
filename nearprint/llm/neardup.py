"""Near-duplicate groups by bottom-k sketches.

A document's set is its distinct five-word shingles; two documents are linked if their sets
have a Jaccard similarity of ``percent`` (85) or more, and a group is a connected component of links.

1.  Documents with equal sets form a class, and one of them speaks for it.
2.  One hash function; the sketch of a set is its ``K`` smallest hashes.  In the union's
    sketch of two linked sets 0.85 of the values are common, give or take: fewer than
    ``floor`` in common has a chance of 8e-9 at exactly 0.85, and far less above; who asks for
    links further apart lowers it.  So they also share one of the rarest
    ``K - floor * K + 1`` values of either, and only these go into inverted lists.
3.  Lists generate pairs.  Short ones give all theirs.  In a long one the smallest member, the
    hub, meets all others.
4.  The union-sketch estimate filters pairs, and the exact Jaccard similarity of the full sets
    verifies what is left.
5.  A long list whose members links have merged into one component, as in a group of copies,
    is done.  The others are put together to families, and these are compared on full sets,
    block against block, without a row for each pair.

No list is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearprint.llm import codes
from nearprint.llm.tables import LAST, buckets, doc_key, materialise, own_names

SHINGLE = 5
PERCENT = 85
K = 64
FLOOR = 0.55
#: Lists up to this length give all their pairs at once.
SHORT_LIST = 16
#: Members in a block of a family, on average.
FAMILY_BLOCK = 512

SETS = "doc bigint, n bigint, s1 bigint, s2 bigint, sketch binary"


def shingles(buf: np.ndarray, places: np.ndarray, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles and the text of each, in order of text and hash."""
    buf = codes.LOWER[buf]
    words = codes.Words(buf, places)
    if not len(words.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words.hashes(codes.rolling(buf))
    grams = codes.word_grams(h, length)
    m = len(grams)
    whole = words.text[:m] == words.text[length - 1 :] if m else np.zeros(0, bool)
    values, texts = [grams[whole]], [words.text[:m][whole]]
    few = np.flatnonzero((words.counts > 0) & (words.counts < length))
    if len(few):  # the whole sequence is the one shingle
        at, end = words.bounds[few], words.bounds[few + 1]
        value = np.zeros(len(few), np.uint64)
        for k in range(length - 1):
            more = at + k < end
            value[more] = codes.mix(value[more] * np.uint64(0x9E3779B97F4A7C15) + h[at[more] + k])
        values.append(codes.mix(value + (end - at).astype(np.uint64)))
        texts.append(few)
    value, text = np.concatenate(values), np.concatenate(texts)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], text[new]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in codes.blocks(batches):
        value, text = shingles(*codes.flat(block.column("text")))
        rows = block.num_rows
        bounds = np.searchsorted(text, np.arange(rows + 1))
        sums = []
        for salt in (0, 0x632BE59BD9B4E019):
            running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.mix(value ^ np.uint64(salt)))])
            sums.append((running[bounds[1:]] - running[bounds[:-1]]).view(np.int64))
        sketches = [value[a : min(b, a + K)].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        columns = [block.column("doc"), pa.array(np.diff(bounds)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "s1", "s2", "sketch"])


def sketches(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n, s1, s2, sketch)``: set size, a hash of the set in two parts, the sketch."""
    return docs.select(doc_key(id_column).alias("doc"), F.col(text).alias("text")).mapInArrow(_sets, SETS)


def _dealt(n: int):
    """Sketch values as one row of packed arrays for each bucket and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            value, places = codes.flat(batch.column("sketch"))
            value = np.frombuffer(value.tobytes(), np.uint64)
            rep = np.repeat(batch.column("doc").to_numpy(), np.diff(places) // 8)
            bucket = codes.mix(value) % np.uint64(n)
            order = np.argsort(bucket, kind="stable")
            distinct, first = np.unique(bucket[order], return_index=True)
            parts = np.split(order, first[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.astype(np.int32)), pa.array([value[p].tobytes() for p in parts], pa.binary()), pa.array([rep[p].tobytes() for p in parts], pa.binary())],
                ["bucket", "value", "rep"],
            )

    return run


def _shared(dealt: pa.Table) -> pa.Table:
    """The values that two classes or more retain, and how many do."""
    value = np.concatenate([np.frombuffer(v.as_py(), np.int64) for v in dealt.column("value")])
    rep = np.concatenate([np.frombuffer(r.as_py(), np.int64) for r in dealt.column("rep")])
    order = np.argsort(value, kind="stable")
    value, rep = value[order], rep[order]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    df = np.repeat(np.diff(np.append(starts, len(value))), np.diff(np.append(starts, len(value))))
    some = df > 1
    return pa.table({"value": value[some], "rep": rep[some], "df": df[some]})


def inverted_lists(classes: DataFrame, floor: float = FLOOR) -> DataFrame:
    """``(value, rep, n, df)``: each class under those of its rarest values that others retain too."""
    n = buckets(classes.sparkSession)
    dealt = classes.select("doc", "sketch").mapInArrow(_dealt(n), "bucket int, value binary, rep binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared, "value bigint, rep bigint, df bigint")
    per_rep = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))  # at most K
    sized = per_rep.join(classes.select(F.col("doc").alias("rep"), "n"), "rep")
    kept = F.least(F.col("n"), F.lit(K))
    prefix = kept - F.ceil(kept * floor) + 1
    # Values nobody else retains are the rarest, and come first in the prefix.
    room = (prefix - (kept - F.size("held"))).cast("int")
    placed = sized.where(room > 0).select("rep", "n", F.explode(F.slice("held", F.lit(1), room)).alias("entry"))
    return placed.select(F.col("entry.value").alias("value"), "rep", "n", F.col("entry.df").alias("df"))


def _estimate(floor: float):
    """Pairs whose union sketch has enough common values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = []
            for name in ("sketch_a", "sketch_b"):
                value, places = codes.flat(batch.column(name))
                sides.append((np.frombuffer(value.tobytes(), np.uint64), np.repeat(np.arange(batch.num_rows), np.diff(places) // 8)))
            value, pair = (np.concatenate(x) for x in zip(*sides, strict=True))
            order = np.lexsort((value, pair))
            value, pair = value[order], pair[order]
            common = np.zeros(len(value), bool)
            common[:-1] = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
            first = ~np.concatenate([[False], common[:-1]])
            common, pair = common[first], pair[first]
            rank = np.arange(len(pair)) - np.searchsorted(pair, pair)
            inside = rank < K
            size = np.bincount(pair[inside], minlength=batch.num_rows)
            both = np.bincount(pair[inside & common], minlength=batch.num_rows)
            near = both >= floor * size
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(near)), batch.column("b").filter(pa.array(near))], ["a", "b"])

    return run


def _verify(percent: int):
    """Pairs that are linked, by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in codes.blocks(batches, "text_a"):
            a, pair_a = shingles(*codes.flat(block.column("text_a")))
            b, pair_b = shingles(*codes.flat(block.column("text_b")))
            value, pair = np.concatenate([a, b]), np.concatenate([pair_a, pair_b])
            order = np.lexsort((value, pair))
            value, pair = value[order], pair[order]
            same = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
            both = np.bincount(pair[1:][same], minlength=block.num_rows)
            union = np.bincount(pair, minlength=block.num_rows) - both
            linked = pa.array((100 * both >= percent * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([block.column("a").filter(linked), block.column("b").filter(linked)], ["a", "b"])

    return run


def components(nodes_of: DataFrame) -> DataFrame:
    """``(node, label)`` of the nodes of links ``(a, b)``: the smallest node that can be reached.

    Each round takes the smallest label among neighbours, then the label of that label.
    """
    edges = materialise(nodes_of.union(nodes_of.select("b", "a")).distinct().toDF("node", "other"), "links")
    labels = materialise(edges.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        stepped = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        stepped = stepped.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "further").alias("label"))
        stepped = materialise(stepped, "labels")
        labels = stepped.select("node", "label")
        if stepped.where("label <> old").isEmpty():
            return labels


def _pairs_of_short_lists(lists: DataFrame) -> DataFrame:
    members = lists.where(F.col("df") <= SHORT_LIST).groupBy("value").agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("m"))
    x = members.select("m", F.posexplode("m").alias("at", "x"))
    y = x.select("x", F.explode(F.slice("m", F.col("at") + 2, F.lit(SHORT_LIST))).alias("y"))
    return y.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))


def links(
    classes: DataFrame, docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT, floor: float = FLOOR
) -> DataFrame:
    """Verified links between class representatives, enough of them to connect every component."""
    lists = materialise(inverted_lists(classes, floor), "lists")
    active = lists.select(F.col("rep").alias("doc")).distinct()
    texts = docs.select(doc_key(id_column).alias("doc"), F.col(text).alias("text")).join(active, "doc")
    texts = materialise(texts, "texts")  # of documents that share a value with another
    held = materialise(classes.join(active, "doc").select("doc", "sketch"), "sketches")

    def verified(pairs: DataFrame) -> DataFrame:
        # 100 * intersection >= percent * union cannot hold for sets of sizes further apart.
        sized = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("a") != F.col("b"))
        pairs = pairs.where(sized).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for side in ("a", "b"):
            pairs = pairs.join(held.select(F.col("doc").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
        pairs = materialise(pairs.mapInArrow(_estimate(floor), "a bigint, b bigint"), "candidates")
        for side in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("doc").alias(side), F.col("text").alias(f"text_{side}")), side)
        return materialise(pairs.mapInArrow(_verify(percent), "a bigint, b bigint"), "verified")

    found = verified(_pairs_of_short_lists(lists))
    # The hub of each long list, its smallest member, meets all others.
    long_lists = lists.where(F.col("df") > SHORT_LIST).select("value", "rep", "n")
    hub = long_lists.groupBy("value").agg(F.min("rep").alias("a")).join(long_lists.withColumnsRenamed({"rep": "a", "n": "n_a"}), ["value", "a"])
    met = long_lists.join(hub, "value").select("a", F.col("rep").alias("b"), "n_a", F.col("n").alias("n_b"))
    found = materialise(found.union(verified(met)), "links")
    labels = components(found)
    named = long_lists.join(labels, F.col("rep") == F.col("node"), "left").select("value", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = named.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("rep").alias("hub")).where("low < high")
    apart = materialise(named.join(mixed.select("value", "hub"), "value").select("rep", "hub"), "apart")
    return found.union(family_links(apart, texts, percent))


def family_links(apart: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links within each family, at most one for each member of a block pair.

    A family is what long lists ``(rep, hub)`` with links missing hold together.  It is cut
    into blocks by hash, and every pair of blocks is compared in a task of its own, on full
    sets; no pair of documents becomes a row.
    """
    families = components(apart.toDF("a", "b"))
    sizes = families.groupBy("label").agg(F.count("*").alias("size"))
    cut = families.join(sizes, "label").withColumn("blocks", F.ceil(F.col("size") / FAMILY_BLOCK))
    own = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    dealt = paired.select(
        F.col("label").alias("family"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.col("node").alias("doc")
    )
    compare = lambda members: _compare(members, percent)
    return dealt.join(texts, "doc").groupBy("family", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _compare(members: pa.Table, percent: int) -> pa.Table:
    """``(a, b)``: members that links join, each with the smallest that it reaches here."""
    doc, own = members.column("doc").to_numpy(), members.column("own").to_numpy()
    value, text = shingles(*codes.flat(members.column("text")))
    size = np.bincount(text, minlength=len(doc))
    _, column, df = np.unique(value, return_inverse=True, return_counts=True)
    shared = df[column] > 1
    column, text = np.unique(column[shared], return_inverse=True)[1], text[shared]
    both = np.zeros((len(doc), len(doc)), np.float32)
    order = np.argsort(column, kind="stable")
    column, text = column[order], text[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        has = np.zeros((len(doc), 4096), np.float32)
        has[text[a:b], column[a:b] - first] = 1
        both += has @ has.T
    union = size[:, None] + size[None, :] - both
    linked = (100 * both >= percent * union) & (size[:, None] > 0)
    i, j = members.column("i")[0].as_py(), members.column("j")[0].as_py()
    if i != j:  # pairs within a block are compared where it meets itself
        linked &= own[:, None] != own[None, :]
    rank = np.argsort(np.argsort(doc, kind="stable"), kind="stable")
    label, before = rank.copy(), None
    while before is None or (label != before).any():
        before = label.copy()
        near = np.where(linked, label[None, :], len(doc)).min(axis=1, initial=len(doc))
        label = np.minimum(label, near)
    back = np.empty(len(doc), np.int64)
    back[rank] = doc
    moved = label != rank
    return pa.table({"a": back[label[moved]], "b": doc[moved]})


def groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT, floor: float = FLOOR
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document.

    A text without words, or null, has the empty set and is linked with nothing.  Equal sets
    are linked.  Rows that share an id, and all with a null id, are one document as to
    links, and each keeps its own set size; null ids come after all others.
    """
    sets = materialise(sketches(docs, id_column, text), "sets")
    classes = sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep"))
    classes = materialise(classes, "classes")
    one = classes.select("s1", "s2", F.col("rep").alias("doc"))
    spoken = sets.join(one, ["doc", "s1", "s2"]).dropDuplicates(["doc", "s1", "s2"]).select("doc", "n", "sketch")
    spoken = materialise(spoken, "representatives")
    labels = components(links(spoken, docs, id_column, text, percent, floor))
    named = classes.join(labels, F.col("rep") == F.col("node"), "left")
    named = named.select("s1", "s2", "n", F.coalesce("label", "rep").alias("component"))
    joined = sets.select("doc", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    component = F.coalesce("component", "doc")
    blank = lambda c: F.when(c != LAST, c)
    return joined.select(
        blank(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), blank(component).alias("component_id"),
        (F.col("doc") == component).alias("kept"),
    )


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT, floor: float = FLOOR
) -> DataFrame:
    """The rows of one document of each group, that of the smallest id, with all their columns."""
    (name,) = own_names(docs, "kept_id")
    kept = groups(docs, id_column, text, percent, floor).where("kept").select(F.coalesce("doc_id", F.lit(LAST)).alias(name)).distinct()
    return docs.join(kept, doc_key(id_column) == F.col(name), "left_semi")
