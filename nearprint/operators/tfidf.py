"""Vocabulary and TF-IDF encoding.

Texts with the same words in the same numbers have the same vector, so they are
collapsed to one *bag* before anything is exploded, counted or joined; document
frequencies are weighted by the number of copies.  A group of copies, however large,
therefore costs one row from here on.

Encoded vectors are kept in long form ``(id, feature_matrix_index, weight)``.

Where every document gets a vector (:func:`encode_texts`) the bags stay whole: they are dealt into
parts of some hundred thousand words, each part asks the vocabulary for its distinct words, and its
vectors are weighted where its bags are.  Nothing is shuffled by posting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from nearprint.functions.tokens import encoder_tokens
from nearprint.storage import materialise

BAG = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("tf", T.IntegerType())]))
#: Words of a part, repeats counted; a longer text is a part of its own.
PART_WORDS = 500_000


def _words(text: str) -> Column:
    """The words of a text, a space after each."""
    tokens = encoder_tokens(text)
    return F.array_join(F.array_append(tokens, F.lit("")), " ")


def _bytes(column: pa.Array) -> np.ndarray:
    """What the strings or binary values hold, end to end."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)


def _counted(lines: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of all texts in the order of their bytes; then where the counts of each text
    begin and end, and of each count the word's place and how often it occurs in the text."""
    sizes = pc.fill_null(pc.count_substring(lines, " "), 0).to_numpy().astype(np.int64)
    # A word and the space after it are a string of their own where they stand.
    buf = _bytes(lines)
    ends = np.concatenate([[0], np.flatnonzero(buf == 32) + 1])
    coded = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buf)).dictionary_encode()
    n = max(1, len(coded.dictionary))
    order = pc.sort_indices(pc.utf8_rtrim(coded.dictionary, characters=" ")).to_numpy()
    place = np.empty(n, np.int64)
    place[order] = np.arange(len(order))
    cells = np.repeat(np.arange(len(sizes)) * n, sizes) + place[coded.indices.to_numpy()]
    cells.sort()
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    tf = np.diff(first, append=len(cells)).astype(np.int32)
    cells = cells[first]
    ends = np.searchsorted(cells, np.arange(len(sizes) + 1) * n).astype(np.int32)
    words = pc.utf8_rtrim(coded.dictionary.take(pa.array(order)), characters=" ").cast(pa.string())
    return words, ends, (cells % n).astype(np.int32), tf


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ends, code, tf = _counted(batch.column("tokens"))
        bag = pa.StructArray.from_arrays([words.take(pa.array(code)), pa.array(tf)], ["word", "tf"])
        bag = pa.ListArray.from_arrays(pa.array(ends), bag, mask=batch.column("tokens").is_null())
        yield pa.RecordBatch.from_arrays([batch.column("id"), bag], ["id", "bag"])


def bags(texts: DataFrame, text: str = "processed_content") -> DataFrame:
    """``(id, bag, bag_key)``: word counts of each text, and a digest equal for equal bags."""
    columns = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("bag", BAG)])
    counted = texts.select("id", _words(text).alias("tokens")).mapInArrow(_bags, columns)
    # No word holds a space.
    flat = F.concat_ws("|", F.array_join("bag.word", " "), F.array_join(F.col("bag.tf").cast("array<string>"), " "))
    return counted.select("id", "bag", F.when(F.col("bag").isNotNull(), F.md5(flat)).alias("bag_key"))


def collapse_copies(bagged: DataFrame) -> DataFrame:
    """``(class_id, bag_key, copies, bag)``: one row per distinct bag.

    A plain aggregate, so copies merge on the map side before the shuffle.
    """
    return bagged.groupBy("bag_key").agg(
        F.min("id").alias("class_id"),
        F.count(F.lit(1)).alias("copies"),
        F.any_value("bag").alias("bag"),
    )


def members(bagged: DataFrame, classes: DataFrame) -> DataFrame:
    """``(id, class_id, copies)``: which bag every document belongs to.

    The class side is unique on the key; runtime skew handling splits a large group of
    copies on the document side.
    """
    return bagged.select("id", "bag_key").join(
        classes.select("bag_key", "class_id", "copies"), "bag_key"
    ).drop("bag_key")


def collapse_texts(texts: DataFrame, text: str = "processed_content") -> tuple[DataFrame, DataFrame]:
    """``(classes, members)`` of ``(id, text)`` rows.  Each text is read and split once."""
    bagged = materialise(bags(texts, text), "bags")
    classes = materialise(collapse_copies(bagged), "classes")
    return classes, members(bagged, classes)


def word_counts(classes: DataFrame) -> DataFrame:
    """``(class_id, copies, word, tf)``: the bags in long form."""
    return classes.select("class_id", "copies", F.inline("bag"))


def document_frequencies(classes: DataFrame) -> DataFrame:
    """``(word, document_frequency)`` over all documents, copies included."""
    return word_counts(classes).groupBy("word").agg(F.sum("copies").alias("document_frequency"))


def document_count(classes: DataFrame) -> Column:
    """Number of documents, those without any word included, as a scalar subquery."""
    return classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).scalar()


def number_in_order(df: DataFrame, by: str, index: str) -> DataFrame:
    """Add a 0-based position in the order of a unique column.

    The rows are range-partitioned and sorted, written once, and each partition's rows
    are shifted by the number of rows in the partitions before it.  No task sees more
    than one range.
    """
    ordered = df.repartitionByRange(by).sortWithinPartitions(by)
    stored = materialise(ordered.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    # The identifier holds the partition above bit 33 and the row within it below.
    place = stored.select(
        "*",
        F.shiftright("_row", 33).cast("int").alias("_part"),
        F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )
    sizes = place.groupBy("_part").agg((F.max("_pos") + 1).alias("_size"))
    # One row per range partition, so a single ordered window over it is small.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return place.join(starts, "_part").select(
        *df.columns, (F.col("_start") + F.col("_pos")).cast("int").alias(index)
    )


def fit_vocabulary(classes: DataFrame) -> DataFrame:
    """``(word, document_frequency, feature_matrix_index)``, indexed alphabetically."""
    return number_in_order(document_frequencies(classes), "word", "feature_matrix_index")


def raw_weights(
    classes: DataFrame,
    vocabulary: DataFrame,
    frequencies: DataFrame | None = None,
    n_documents: Column | None = None,
) -> DataFrame:
    """Unnormalised TF-IDF: ``tf * (ln((1 + n) / (1 + df)) + 1)``.

    ``frequencies`` gives document frequencies when the vocabulary carries none; words
    outside the vocabulary are dropped by the join.
    """
    if frequencies is not None:
        vocabulary = vocabulary.select("word", "feature_matrix_index").join(frequencies, "word")
    n = document_count(classes) if n_documents is None else n_documents
    # Computed once per word, before the join with the far larger postings.
    terms = vocabulary.select(
        "word",
        "feature_matrix_index",
        "document_frequency",
        (F.ln((1 + n) / (1 + F.col("document_frequency"))) + 1).alias("_idf"),
    )
    return word_counts(classes).join(terms, "word").select(
        F.col("class_id").alias("id"),
        "feature_matrix_index",
        "document_frequency",
        (F.col("tf") * F.col("_idf")).alias("weight"),
    )


def unit_length(weights: DataFrame) -> DataFrame:
    """Divide each vector by its Euclidean norm; a zero vector stays zero."""
    # Summed in index order, so equal vectors get equal weights to the last bit.
    whole = (
        W.partitionBy("id").orderBy("feature_matrix_index")
        .rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(whole))
    return weights.withColumn("weight", F.when(norm > 0, F.col("weight") / norm).otherwise(F.lit(0.0)))


def encode(
    classes: DataFrame,
    vocabulary: DataFrame,
    frequencies: DataFrame | None = None,
    n_documents: Column | None = None,
) -> DataFrame:
    """Unit TF-IDF vectors of the classes, in long form."""
    return unit_length(raw_weights(classes, vocabulary, frequencies, n_documents))


def for_documents(encoded: DataFrame, member_table: DataFrame) -> DataFrame:
    """Give every document the vector of its class."""
    return (
        member_table.select(F.col("id").alias("_doc"), F.col("class_id").alias("id"))
        .join(encoded, "id")
        .drop("id")
        .withColumnRenamed("_doc", "id")
        .select("id", *[c for c in encoded.columns if c != "id"])
    )


def frequency_rows(texts: DataFrame, by: str = "publication", text: str = "processed_content") -> DataFrame:
    """``(by, word, document_frequency, id)``: what texts add to a table of stored frequencies.

    A row for each word and ``by``, without an id, and one for each text, without a word.  Written
    at once, a text is counted exactly if its row is there.
    """
    counted = texts.select(F.col(by).alias("_by"), F.array_distinct(encoder_tokens(text)).alias("_words"))
    words = counted.select(F.col("_by").alias(by), F.explode("_words").alias("word")).groupBy(by, "word").agg(
        F.count(F.lit(1)).alias("document_frequency")
    )
    ids = texts.select(by, F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("document_frequency"), "id")
    return words.withColumn("id", F.lit(None).cast(texts.schema["id"].dataType)).unionByName(ids)


def stored_frequencies(rows: DataFrame) -> tuple[DataFrame, Column]:
    """``(frequencies, number of documents)`` of rows of such a table."""
    words = rows.where("word IS NOT NULL").groupBy("word").agg(F.sum("document_frequency").alias("document_frequency"))
    return words, rows.where("id IS NOT NULL").agg(F.count(F.lit(1))).scalar()


DEALT = ["part", "id", "codes", "tf", "words"]


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, tokens)`` to rows of :func:`dealt`."""
    part, held, room = TaskContext.get().partitionId() << 32, [], PART_WORDS
    for batch in batches:
        sizes = np.maximum(1, pc.fill_null(pc.count_substring(batch.column("tokens"), " "), 0).to_numpy())
        start = 0
        for k, size in enumerate(sizes.tolist()):
            if size > room and (held or k > start):
                yield from _part_rows(part, [*held, batch.slice(start, k - start)])
                part, held, room, start = part + 1, [], PART_WORDS, k
            room -= size
        held.append(batch.slice(start))
    if held:
        yield from _part_rows(part, held)


def _part_rows(part: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches).combine_chunks()
    n, ids = len(rows), rows.column("id").combine_chunks()
    if not n:
        return
    words, ends, code, tf = _counted(rows.column("tokens").combine_chunks())
    entries = pa.StructArray.from_arrays([words, pa.array(np.bincount(code, minlength=len(words)))], ["word", "texts"])
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), entries)
    # Whole numbers of 32 bits, packed: a value of its own for each would cost more to pass on than to count.
    codes, times = (pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(4 * ends), pa.py_buffer(v)]) for v in (code, tf))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), ids, codes, times, pa.nulls(n, whole.type)], DEALT)
    none = [pa.nulls(1, c.type) for c in (ids, codes, times)]
    yield pa.RecordBatch.from_arrays([pa.array([part]), *none, whole], DEALT)


def dealt(texts: DataFrame, text: str = "processed_content") -> tuple[DataFrame, DataFrame]:
    """``(bags, part words)``: ``(part, id, codes, tf)`` of each text, and ``(part, code, word, texts)``.

    A part numbers its distinct words; ``texts`` is how many of its texts hold the word.  The
    numbers of a text's words, and how often each occurs, are packed, 32 bits each.
    """
    entry = T.StructType([T.StructField("word", T.StringType()), T.StructField("texts", T.LongType())])
    columns = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("id", texts.schema["id"].dataType), T.StructField("codes", T.BinaryType()),
        T.StructField("tf", T.BinaryType()), T.StructField("words", T.ArrayType(entry)),
    ])
    stored = materialise(texts.select("id", _words(text).alias("tokens")).mapInArrow(_deal, columns), "dealt")
    words = stored.where("words IS NOT NULL").select("part", F.posexplode("words").alias("code", "entry"))
    # Named anew, the part is a column of its own, which the bags can be grouped with.
    return stored.where("words IS NULL").drop("words"), words.select(F.col("part").alias("part"), "code", "entry.word", "entry.texts")


def _frequencies(part_words: DataFrame) -> DataFrame:
    return part_words.groupBy("word").agg(F.sum("texts").alias("document_frequency"))


def _weigh(texts: pa.Table, terms: pa.Table, keep_empty: bool) -> pa.Table:
    """Unit vectors of the texts of a part, in long form, from the terms its words were found to be."""
    texts, terms = texts.combine_chunks(), terms.combine_chunks()
    n = len(texts)
    packed = [texts.column(c).combine_chunks() if n else pa.array([], pa.binary()) for c in ("codes", "tf")]
    row = np.repeat(np.arange(n), pc.binary_length(packed[0]).to_numpy() // 4)
    code, tf = (_bytes(c).view(np.int32) for c in packed)
    place = np.full(int(code.max()) + 1 if len(code) else 1, -1)
    place[terms.column("code").to_numpy()] = np.arange(len(terms))
    found = place[code]
    known = found >= 0
    row, found, tf = row[known], found[known], tf[known]
    index, frequency, idf = (terms.column(c).to_numpy()[found] for c in ("feature_matrix_index", "document_frequency", "idf"))
    weight = tf * idf
    # Summed in index order, so equal vectors get equal weights to the last bit.
    cells = row * (1 << 31) + index
    if (np.diff(cells) < 0).any():
        order = np.argsort(cells, kind="stable")
        row, index, frequency, weight = row[order], index[order], frequency[order], weight[order]
    norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=n))[row]
    weight = np.divide(weight, norm, out=np.zeros(len(weight)), where=norm > 0)
    columns = [pa.array(row), pa.array(index, pa.int32()), pa.array(frequency, pa.int64()), pa.array(weight, pa.float64())]
    if keep_empty:
        empty = np.flatnonzero(np.bincount(row, minlength=n) == 0)
        columns = [pa.concat_arrays([c, pa.array(empty, c.type) if k == 0 else pa.nulls(len(empty), c.type)]) for k, c in enumerate(columns)]
    ids = texts.column("id").combine_chunks().take(columns[0]) if n else pa.nulls(0, texts.schema.field("id").type)
    return pa.table([ids, *columns[1:]], names=["id", "feature_matrix_index", "document_frequency", "weight"])


def _encode_parts(parts: DataFrame, part_words: DataFrame, vocabulary: DataFrame, n_documents: Column, keep_empty: bool) -> DataFrame:
    idf = F.ln((1 + n_documents) / (1 + F.col("document_frequency"))) + 1
    terms = vocabulary.select("word", F.col("feature_matrix_index").cast("int"), F.col("document_frequency").cast("long"), idf.alias("idf"))
    answers = part_words.join(terms, "word").select("part", "code", "feature_matrix_index", "document_frequency", "idf")
    columns = T.StructType([
        T.StructField("id", parts.schema["id"].dataType), T.StructField("feature_matrix_index", T.IntegerType()),
        T.StructField("document_frequency", T.LongType()), T.StructField("weight", T.DoubleType()),
    ])

    def weigh(texts: pa.Table, terms: pa.Table) -> pa.Table:
        return _weigh(texts, terms, keep_empty)

    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(weigh, columns)


def encode_texts(
    texts: DataFrame,
    vocabulary: DataFrame | None = None,
    corpus: DataFrame | None = None,
    text: str = "processed_content",
    counted: tuple[DataFrame, Column] | None = None,
    keep_empty: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(encoded, vocabulary)`` for ``(id, text)`` rows.

    Without ``vocabulary`` one is fitted on the texts (the re-fit mode).  With it, words
    and indices are fixed, and document frequencies come from ``counted`` (as
    :func:`stored_frequencies` gives them) or from ``corpus`` when given, or from the texts
    alone (the batch scope).  With ``keep_empty`` a text without any known word has one row
    without index and weight.
    """
    parts, part_words = dealt(texts, text)
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    if vocabulary is None:
        vocabulary = number_in_order(_frequencies(part_words), "word", "feature_matrix_index")
        return _encode_parts(parts, part_words, vocabulary, count(parts), keep_empty), vocabulary
    if counted is not None:
        frequencies, n_documents = counted
    elif corpus is not None:
        basis, basis_words = dealt(corpus, text)
        frequencies, n_documents = _frequencies(basis_words), count(basis)
    else:
        frequencies, n_documents = _frequencies(part_words), count(parts)
    # A batch word the corpus has never held counts as unseen, not as unknown.
    how = "left" if corpus is not None or counted is not None else "inner"
    terms = vocabulary.select("word", "feature_matrix_index").join(frequencies, "word", how)
    terms = terms.withColumn("document_frequency", F.coalesce("document_frequency", F.lit(0)))
    return _encode_parts(parts, part_words, terms, n_documents, keep_empty), vocabulary


def sparse_vectors(encoded: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(id, indices, weights)`` in index order; ids without any word get empty arrays."""
    entry = F.struct("feature_matrix_index", "weight")
    packed = encoded.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    if ids is not None:
        packed = ids.select("id").join(packed, "id", "left")
    none = F.array().cast(T.ArrayType(T.StructType([
        T.StructField("feature_matrix_index", T.IntegerType()),
        T.StructField("weight", T.DoubleType()),
    ])))
    entries = F.coalesce("_entries", none)
    return packed.select(
        "id",
        entries["feature_matrix_index"].alias("indices"),
        entries["weight"].alias("weights"),
    )


def dense_vectors(encoded: DataFrame, width: int, ids: DataFrame | None = None) -> DataFrame:
    """``(id, encoded)``: one slot per vocabulary word.  Only for small vocabularies."""
    sparse = sparse_vectors(encoded, ids)
    slots = F.map_from_arrays("indices", "weights")
    return sparse.select(
        "id",
        F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda i: F.coalesce(F.try_element_at(slots, i), F.lit(0.0)),
        ).alias("encoded"),
    )


def from_dense(vectors: DataFrame, column: str = "encoded") -> DataFrame:
    """Stored arrays back to long form, zeros left out, lengths made 1."""
    values = F.col(column).cast("array<double>")
    long = vectors.select("id", F.posexplode(values).alias("feature_matrix_index", "weight"))
    return unit_length(long.where(F.col("weight") != 0))
