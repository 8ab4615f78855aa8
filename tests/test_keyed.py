from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from nearprint.operators import keyed


def frame(spark, values, name="k", kind="int"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_unprocessed_with_other_key_name(spark, rows):
    assert rows(keyed.unprocessed(frame(spark, [1, 2, 3]), frame(spark, [2, 2], "id"), "k", "id")) == [(1,), (3,)]


@pytest.mark.parametrize("source, target, expected", [
    ([1, 2], [2], [(1,)]),
    ([1, 2], [2, None], []),
    ([1, None], [2], [(1,)]),
    ([1, None], [], [(1,), (None,)]),
])
def test_not_in_follows_sql(spark, rows, source, target, expected):
    assert rows(keyed.not_in(frame(spark, source), frame(spark, target), "k")) == expected


def test_null_aware_anti_join_broadcasts_no_table(spark):
    big = spark.range(10).select(F.col("id").alias("k"))
    plan = keyed.not_in(big, spark.range(5).select(F.col("id").alias("k")), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "isnull((k" not in plan


def test_contained_and_exists(spark, rows):
    assert rows(keyed.contained(frame(spark, [1, 2, 2]), frame(spark, [2], "x"), "k", "x")) == [(2,), (2,)]
    assert keyed.exists(frame(spark, [1]), F.col("k") == 1).first()[0] is True
    assert keyed.exists(frame(spark, [1]), F.col("k") == 5).first()[0] is False


def test_keep_first_and_last(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], "k string, at int, v string")
    assert rows(keyed.keep_first(df, ["k"], [F.asc("at")])) == [("a", 1, "x"), ("b", 5, "z")]
    assert rows(keyed.keep_last(df, ["k"], ["at"])) == [("a", 2, "y"), ("b", 5, "z")]


def test_keep_first_thins_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = keyed.keep_first(df, ["k"], [F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_newest_puts_missing_times_first(spark, rows):
    df = spark.createDataFrame([(1, "2020-01-01"), (2, None), (3, "2021-01-01")], "k int, ts string")
    assert [r.k for r in keyed.newest(df, "ts", 2, "k").collect()] == [2, 3]


def test_drop_incomplete(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, "y")], "k int, v string")
    assert rows(keyed.drop_incomplete(df)) == [(2, "x")]
    assert rows(keyed.drop_incomplete(df, ["k"])) == [(1, None), (2, "x")]


def test_concat_fills_missing_columns(spark, rows):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    assert rows(keyed.concat([a, frame(spark, [2])])) == [(1, "x"), (2, None)]


def test_new_rows_with_two_keys(spark, rows):
    target = spark.createDataFrame([("p", 1, "old")], "a string, b int, v string")
    batch = spark.createDataFrame([("p", 1, "new"), ("q", 1, "z"), ("q", 1, "y"), (None, 1, "x")], "a string, b int, v string")
    assert rows(keyed.new_rows(target, batch, ["a", "b"])) == [("q", 1, "y")]
    assert rows(keyed.merge_new_rows(target, batch, ["a", "b"])) == [("p", 1, "old"), ("q", 1, "y")]


def test_merge_vertices(spark, rows):
    schema = "id string, publication string, title string, url string"
    stored = spark.createDataFrame([("1", "P", "A", "u")], schema)
    batch = spark.createDataFrame([("1", "P", "A", "u"), ("1", "P", "B", "u"), ("2", "Q", "C", "v"), ("2", "Q", "C", "v"), ("2", "Q", "D", "v")], schema)
    merged, conflicts = keyed.merge_vertices(stored, batch)
    assert rows(merged) == [("1", "P", "A", "u"), ("2", "Q", "C", "v")]
    assert rows(conflicts) == [("1", "P", "B", "u"), ("2", "Q", "D", "v")]
