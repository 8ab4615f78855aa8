"""The stages of the pipeline, each on what the one before it kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from nearprint.llm import neardup
from nearprint.llm.tables import materialise
from tests.llm.data import CLASH, WORD, documents

SF_DIR = "/root/testdata/sf0.001"


def test_stages_work_on_what_was_kept(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, counts, tables = docs.columns, [docs.count()], [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_DIR), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        counts.append(docs.count())
        tables.append(docs)
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    mixed = Counter(r["doc_id"] for r in tables[4].select("doc_id").collect())
    assert set(mixed) <= {r["doc_id"] for r in tables[3].select("doc_id").collect()}
    assert max(mixed.values()) <= 3
    packed = Counter(r["doc_id"] for r in tables[5].where("piece = 0").select("doc_id").collect())
    assert packed == mixed
    run = corpus_pipeline.run(spark, SF_DIR)
    assert Counter(r["doc_id"] for r in run.where("piece = 0").collect()) == packed


def test_filters_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1")
    clean = {r["doc_id"] for r in labels.join(docs, "doc_id").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, SF_DIR).collect()}
    assert len(clean & kept) >= 0.98 * len(clean)


def test_awkward_rows_go_through(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = materialise(stage(spark, docs, SF_DIR), "stage")
    assert docs.count() > 0


def test_stages_take_clashing_columns_and_empty_tables(spark):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name in CLASH:
        given = given.selectExpr("*", f"'own' AS `{name}`")
    docs, none = given, given.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF_DIR).collect() == []
        docs = materialise(stage(spark, docs, SF_DIR), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == given.columns
            assert docs.where("kept = 'own' AND copies = 'own'").count() == docs.count() > 0


def test_wordless_documents_of_a_clamped_source_stay_within_the_epochs(spark):
    rows = [(k, "one two three" if k >= 30 else ["", None, " \n"][k % 3], "en", "a", 1) for k in range(40)]
    rows += [(100 + k, "word " * 2_000, "en", "b", 1) for k in range(20)]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, SF_DIR).collect())
    assert {mixed[k] for k in range(40)} == {3}


def test_emptied_documents_go(spark):
    text = "a line of text\nanother line of text\na third line"
    rows = [(1, text, "en", "a", len(text)), (2, text, "en", "a", len(text)), (3, None, "en", "a", None), (4, "x\n" + text, "en", "a", 50)]
    left = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, documents(spark).schema), SF_DIR).collect()
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in left) == [(1, text, len(text)), (3, None, None), (4, "x", 1)]
    assert WORD.search(left[0]["text"] or "x")


@pytest.mark.parametrize("short", [16, 1])
def test_near_copies_from_four_fifths_on_go(spark, monkeypatch, short):
    monkeypatch.setattr(neardup, "SHORT_LIST", short)
    rows = []
    for k in range(20):  # 500 shingles; with the last w words changed, 500 - w of 500 + w are common
        body = [f"w{k}x{i}" for i in range(504)]
        for copy, w in enumerate((0, 50, 55, 60)):  # Jaccard similarities of 0.82, 0.80 and 0.79 to the first
            rows.append((1000 * k + copy, " ".join(body[: 504 - w] + [f"c{copy}x{i}" for i in range(w)]), "en", "a", 1))
    docs = spark.createDataFrame(rows, documents(spark).schema)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF_DIR).collect())
    assert kept == sorted(1000 * k + copy for k in range(20) for copy in (0, 3))
    assert neardup.groups(docs).where("kept").count() == len(rows)
