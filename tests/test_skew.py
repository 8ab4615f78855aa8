"""A third of all rows under one key: runtime skew handling splits the joins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from nearprint.operators import tfidf
from nearprint.storage import materialise
from tests.conftest import settings

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "64",
}


def executed_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    """Every text holds the same word; a third of them are copies of one."""
    text = F.when(F.col("id") % 3 == 0, F.lit("same words here")).otherwise(
        F.concat_ws(" ", F.lit("here"), F.sha2(F.col("id").cast("string"), 256))
    )
    return spark.range(0, 20000, 1, 8).select(F.col("id").cast("string").alias("id"), text.alias("processed_content"))


def test_copies_cost_one_row(spark, texts):
    classes, _ = tfidf.collapse_texts(texts)
    assert classes.count() == 20000 - 20000 // 3
    assert classes.agg(F.max("copies")).first()[0] == 6667


def test_frequent_word_is_split(spark, texts):
    with settings(spark, SMALL):
        classes = materialise(tfidf.collapse_copies(tfidf.bags(texts)).repartition(8), "classes")
        vocabulary = materialise(tfidf.fit_vocabulary(classes), "vocabulary")
        encoded = tfidf.encode(classes, vocabulary)
        assert "skew=true" in executed_plan(encoded)


def test_large_group_of_copies_is_split(spark, texts):
    with settings(spark, SMALL):
        bagged = materialise(tfidf.bags(texts).repartition(8), "bags")
        classes = materialise(tfidf.collapse_copies(bagged), "classes")
        assert "skew=true" in executed_plan(tfidf.members(bagged, classes))
