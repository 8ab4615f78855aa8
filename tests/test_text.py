from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from nearprint.functions import tokens
from nearprint.operators import text, tfidf

LEMMAS = [("contains", "contain"), ("words", "word"), ("spaces", "space"), ("removing", "remove"), ("thinking", "think"),
          ("contractions", "contraction"), ("playing", "play")]
GOLDEN = [
    ("This is a text which contains some stop words", "text contain stop word"),
    ("This text Contains some UPPERCASING", "text contains uppercasing"),
    ("This text contains some high-profile punctuation! ...", "text contain high profile punctuation"),
    ("This text contains multiple spaces    in      it which need removing", "text contain multiple space need remove"),
    ("This text contains some words that require lemmatisation as we are playing with the processor class",
     "text contain word require lemmatisation play processor class"),
    ("This text contains some contractions shan't it. Alicia's thinking so too", "text contain contraction shall alicia think"),
    ("resigned on 22 November 1990.", "resigned 22 november 1990"),
    ("", ""),
    ("the of and", ""),
]


def test_normalise_goldens(spark):
    articles = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(GOLDEN)], "id string, content string")
    lemmas = spark.createDataFrame(LEMMAS, "word string, lemma string")
    stops = {"en": text.stop_words("en")}
    done = text.normalise(articles, stops, lemmas, contractions={"shan't": "shall"})
    found = {r.id: r.processed_content for r in done.collect()}
    for i, (_, expected) in enumerate(GOLDEN):
        assert found[str(i)] == expected
    # Without lemmas only the inflections stay.
    plain = {r.id: r.processed_content for r in text.normalise(articles, stops).collect()}
    assert plain["1"] == "text contains uppercasing" and plain["0"] == "text contains stop words" and plain["8"] == ""


def test_stop_words_follow_the_language(spark):
    articles = spark.createDataFrame([("1", "der die the", "de"), ("2", "der die the", "en"), ("3", "the", None)],
                                     "id string, content string, lang string")
    done = text.normalise(articles, text.default_stop_words(), lang="lang")
    assert {r.id: r.processed_content for r in done.collect()} == {"1": "the", "2": "der die", "3": "the"}


def test_normalise_new(spark, rows):
    articles = spark.createDataFrame([("1", "one text"), ("2", "two texts")], "id string, content string")
    done = spark.createDataFrame([("1", "x")], "id string, processed_content string")
    assert rows(text.normalise_new(articles, done, stops={"en": ("a",)})) == [("2", "two texts")]


def test_stop_lists_have_a_bound(spark):
    articles = spark.createDataFrame([("1", "x")], "id string, content string")
    with pytest.raises(ValueError):
        text.normalise(articles, {"en": tuple(map(str, range(text.MAX_STOP_WORDS + 1)))})


def test_encoder_tokens_and_counts(spark):
    row = spark.createDataFrame([("A été, b2 été_x! c B2",)], "t string").select(
        tokens.encoder_tokens("t").alias("tokens"), tokens.count_words(tokens.encoder_tokens("t")).alias("bag")
    ).first()
    assert row.tokens == ["été", "b2", "été_x", "b2"]
    assert [tuple(x) for x in row.bag] == [("b2", 2), ("été", 1), ("été_x", 1)]


def classes_of(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, processed_content string")
    return df, tfidf.collapse_copies(tfidf.bags(df))


def test_vocabulary_golden(spark, rows):
    _, classes = classes_of(spark, "some words", "some more words")
    fitted = tfidf.fit_vocabulary(classes).select("word", "feature_matrix_index", "document_frequency")
    assert rows(fitted) == [("more", 0, 1), ("some", 1, 2), ("words", 2, 2)]


def test_vocabulary_index_is_gapless_over_partitions(spark):
    words = spark.range(5000).select(F.concat(F.lit("w"), F.sha2(F.col("id").cast("string"), 256)).alias("word"))
    numbered = tfidf.number_in_order(words.repartition(7), "word", "i").collect()
    ordered = sorted(numbered, key=lambda r: r.word)
    assert [r.i for r in ordered] == list(range(5000))


FIXED = [("and", 0), ("content", 1), ("other", 2), ("preprocessed", 3), ("some", 4), ("words", 5)]


def test_fixed_vocabulary_golden(spark):
    texts, _ = classes_of(spark, "some preprocessed content", "unknown thing")
    vocabulary = spark.createDataFrame(FIXED, "word string, feature_matrix_index int")
    encoded, _ = tfidf.encode_texts(texts.where("id = '0'"), vocabulary)
    dense = tfidf.dense_vectors(encoded, 6, texts)
    found = {r.id: r.encoded for r in dense.collect()}
    third = 1 / math.sqrt(3)
    assert found["0"] == pytest.approx([0, third, 0, third, third, 0])
    assert found["1"] == [0.0] * 6


def test_refit_golden(spark):
    texts, _ = classes_of(spark, "some preprocessed content")
    encoded, vocabulary = tfidf.encode_texts(texts)
    assert tfidf.dense_vectors(encoded, 3).first().encoded == pytest.approx([1 / math.sqrt(3)] * 3)
    assert {r.word: r.feature_matrix_index for r in vocabulary.collect()} == {"content": 0, "preprocessed": 1, "some": 2}


def test_weights_of_copies_and_unit_length(spark):
    texts, _ = classes_of(spark, "aa bb", "bb aa", "aa cc cc", "")
    encoded, _ = tfidf.encode_texts(texts)
    found: dict[str, dict[int, float]] = {}
    for r in encoded.collect():
        found.setdefault(r.id, {})[r.feature_matrix_index] = r.weight
    assert found["0"] == found["1"] and "3" not in found
    aa, cc = math.log(5 / 4) + 1, 2 * (math.log(5 / 2) + 1)
    assert found["2"] == pytest.approx({0: aa / math.hypot(aa, cc), 2: cc / math.hypot(aa, cc)})
    for vector in found.values():
        assert math.hypot(*vector.values()) == pytest.approx(1)


def test_incremental_equals_whole_with_corpus_scope(spark):
    texts, _ = classes_of(spark, "aa bb", "bb cc", "aa cc cc", "dd")
    whole, vocabulary = tfidf.encode_texts(texts)
    part, _ = tfidf.encode_texts(texts.where("id > '1'"), vocabulary.select("word", "feature_matrix_index"), texts)
    key = lambda df: {(r.id, r.feature_matrix_index): round(r.weight, 12) for r in df.collect()}
    expected = {k: v for k, v in key(whole).items() if k[0] > "1"}
    assert key(part) == expected


def test_no_texts(spark):
    texts, _ = classes_of(spark, "aa")
    encoded, vocabulary = tfidf.encode_texts(texts.where("false"))
    assert encoded.count() == 0 and vocabulary.count() == 0


def test_both_modes_agree_on_nulls_and_shared_ids(spark):
    given = [(1, "Alpha gamma"), (1, "beta delta"), (1, "beta delta"), (2, None), (3, ""), (4, "of"), (None, "omega")]
    articles = spark.createDataFrame(given, "id int, content string")
    stops = {"en": ("of",)}
    nothing = spark.createDataFrame([], "word string, lemma string")
    plain = text.normalise(articles, stops).collect()
    looked_up = text.normalise(articles, stops, nothing).collect()
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(plain) == order(looked_up)
    assert order(plain) == order([(1, "alpha gamma"), (1, "beta delta"), (1, "beta delta"), (2, None), (3, ""), (4, ""), (None, "omega")])


def test_key_of_several_columns(spark, rows):
    articles = spark.createDataFrame([("a", 1, "one"), ("b", 1, "two")], "publication string, id int, content string")
    done = spark.createDataFrame([("a", 1)], "publication string, id int")
    assert rows(text.normalise_new(articles, done, key=["publication", "id"], stops={"en": ("of",)})) == [("b", 1, "two")]


def test_lemma_tables_of_either_size_agree(spark):
    given = [(1, "words contains Words"), (1, "words contains Words"), (1, "of"), (2, None), (3, ""), (None, "spaces " * 9)]
    articles = spark.createDataFrame(given, "id int, content string").repartition(3)
    lemmas = spark.createDataFrame([*LEMMAS, ("same", "same")], "word string, lemma string")
    stops = {"en": ("of",)}
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    small = text.normalise(articles, stops, lemmas)
    assert order(small) == order(text.normalise(articles, stops, lemmas, lemma_bytes=0))
    assert (None, " ".join(["space"] * 9)) in order(small) and (2, None) in order(small)
    assert text.normalise(articles.where("false"), stops, lemmas).count() == 0


def test_lemma_lookup_moves_no_text(spark):
    articles = spark.createDataFrame([(1, "words")], "id int, content string")
    lemmas = spark.createDataFrame(LEMMAS, "word string, lemma string")
    plan = text.normalise(articles, {"en": ("of",)}, lemmas)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
