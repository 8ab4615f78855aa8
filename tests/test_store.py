from __future__ import annotations

from datetime import datetime

import os
import subprocess
import sys
import threading

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearprint import schemas
from nearprint.sources import files
from nearprint.sources.files import append_csv, read_csv
from nearprint.sources.store import Layout
from nearprint.storage import new_folder

EXAMPLE = T.StructType([
    T.StructField("example_integer", T.IntegerType()),
    T.StructField("example_string", T.StringType()),
    T.StructField("example_timestamp", T.TimestampNTZType()),
])
STORED = [
    (1, "First value", datetime(2020, 1, 1, 1, 1, 1)),
    (2, "Second value", datetime(2020, 2, 2, 2, 2, 2)),
]


@pytest.fixture
def example(spark, store, schema):
    store.create("example", schema, EXAMPLE)
    store.write(spark.createDataFrame(STORED, EXAMPLE), "example", schema, "append")
    return schema


def test_read_table_and_query(store, example, rows):
    assert rows(store.read("example", example)) == STORED
    query = f"SELECT example_integer, example_string FROM {example}.example WHERE example_integer = :id"
    assert rows(store.read(query=query, params={"id": 1})) == [(1, "First value")]


@pytest.mark.parametrize("arguments", [
    {"table": "t", "schema": "s", "query": "SELECT 1"},
    {"table": "t"},
    {"table": "t", "schema": "s", "params": {"a": 1}},
    {},
])
def test_read_rejects_unclear_arguments(store, arguments):
    with pytest.raises(ValueError):
        store.read(**arguments)


def test_columns(store, example):
    assert store.columns("example", example) == EXAMPLE.names
    with pytest.raises(AnalysisException):
        store.columns("missing", example)


def test_extremes(store, example):
    assert store.extreme("example", example, "min", "example_integer") == 1
    assert store.extreme("example", example, "max", "example_integer") == 2
    assert store.extreme("example", example, "max", "example_timestamp") == datetime(2020, 2, 2, 2, 2, 2)
    with pytest.raises(ValueError):
        store.extreme("example", example, "mean", "example_integer")


def test_extreme_of_an_empty_table(store, schema):
    store.create("empty", schema, EXAMPLE)
    assert store.extreme("empty", schema, "max", "example_integer") is None


def test_contains(store, example):
    assert store.contains("First value", "example", example, "example_string") is True
    assert store.contains("non-existent value", "example", example, "example_string") is False


def test_write_modes(spark, store, example, rows):
    extra = spark.createDataFrame([(datetime(2021, 1, 1), 3, "x")], "example_timestamp timestamp_ntz, example_integer int, example_string string")
    with pytest.raises(AnalysisException):
        store.write(extra, "example", example)
    store.write(extra, "example", example, "append")
    assert store.read("example", example).count() == 3
    store.write(extra.select("example_integer"), "example", example, "replace")
    assert rows(store.read("example", example)) == [(3,)]
    with pytest.raises(ValueError):
        store.write(extra, "example", example, "upsert")


def test_insert_new_only(spark, store, example, rows):
    batch = spark.createDataFrame(
        [("changed", datetime(2021, 1, 1), 1), ("new", datetime(2021, 1, 1), 99), ("later", datetime(2021, 1, 1), 99)],
        "example_string string, example_timestamp timestamp_ntz, example_integer int",
    )
    for _ in range(2):
        store.insert_new_only(batch, "example", example, "example_integer", [F.desc("example_string")])
        assert rows(store.read("example", example)) == [*STORED, (99, "new", datetime(2021, 1, 1))]


def test_insert_checks_the_columns(spark, store, example):
    extra = spark.createDataFrame(STORED, EXAMPLE).withColumn("other", F.lit(1))
    with pytest.raises(ValueError, match="other"):
        store.insert_new_only(extra, "example", example, "example_integer")
    with pytest.raises(ValueError, match="example_string"):
        store.insert_new_only(extra.drop("other", "example_string"), "example", example, "example_integer")


def test_replace_may_read_the_table(store, example, rows):
    doubled = store.read("example", example).withColumn("example_integer", F.col("example_integer") * 2)
    store.replace(doubled, "example", example)
    assert [r[0] for r in rows(store.read("example", example))] == [2, 4]
    assert store.columns("example", example) == EXAMPLE.names


def test_cut_off_swap_is_finished(spark, store, example, rows):
    spark.sql(f"ALTER TABLE {example}.example RENAME TO {example}.example__old")
    store.recover("example", example)
    assert rows(store.read("example", example)) == STORED


def test_delete(store, example, rows):
    store.delete("example", example, ~F.col("example_string").isin("First value"))
    assert rows(store.read("example", example)) == STORED[:1]


def test_execute(store, example, rows):
    store.execute(f"INSERT INTO {example}.example VALUES (:n, 'third', NULL)", {"n": 3})
    assert rows(store.read("example", example)) == [*STORED, (3, "third", None)]


def test_csv_append(spark, rows):
    folder = new_folder(spark, "csv")
    frame = spark.createDataFrame([(1, 'a, "quoted"\nline'), (2, "b")], "n int, s string")
    append_csv(frame, folder)
    append_csv(frame, folder)
    assert rows(read_csv(spark, folder, frame.schema)) == sorted(2 * [(1, 'a, "quoted"\nline'), (2, "b")])


def test_csv_vectors_and_header_only(spark, tmp_path, rows):
    encoded = T.StructType([T.StructField("id", T.StringType()), T.StructField("encoded", T.ArrayType(T.DoubleType()))])
    (tmp_path / "v.csv").write_text('id,encoded\na,"{1.0, 0.0}"\n')
    assert rows(read_csv(spark, str(tmp_path / "v.csv"), encoded)) == [("a", [1.0, 0.0])]
    (tmp_path / "h.csv").write_text("id,processed_content\n")
    assert read_csv(spark, str(tmp_path / "h.csv"), schemas.NORMALISED_CONTENT).count() == 0


def test_a_plain_installation_needs_no_settings(tmp_path):
    """Defaults without a shared folder: a fresh process writes and reads an intermediate table."""
    script = (
        "from nearprint.session import local_session\n"
        "from nearprint.storage import materialise, shared_dir\n"
        "spark = local_session('plain', 1, '1g')\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert materialise(spark.range(5), 'plain').count() == 5\n"
        "assert shared_dir(spark) == shared_dir(spark.newSession())\n"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(sys.path)}
    subprocess.run([sys.executable, "-c", script], env=env, check=True, timeout=120)


@pytest.mark.parametrize("partition_by, buckets", [((), 0), (("part",), 0), (("part",), 2)])
def test_readers_see_whole_contents_during_replacement(spark, store, schema, partition_by, buckets):
    columns = T.StructType([T.StructField("id", T.LongType()), T.StructField("version", T.IntegerType()), T.StructField("part", T.IntegerType())])
    store.create("rows", schema, columns, partition_by, "id" if buckets else None, buckets)

    def contents(version):
        return spark.range(200).select("id", F.lit(version).alias("version"), (F.col("id") % 3).cast("int").alias("part"))

    store.replace(contents(0), "rows", schema)
    seen, failed, stop = set(), [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                rows = spark.newSession().table(f"{schema}.rows").groupBy("version").count().collect()
                seen.add(tuple(tuple(r) for r in rows))
            except Exception as error:  # noqa: BLE001
                failed.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    early = store.read("rows", schema)
    early_plan = early._jdf.queryExecution().executedPlan()  # has listed its files
    for version in range(1, 5):
        store.replace(contents(version), "rows", schema)
    stop.set()
    reader.join()
    assert not failed and early_plan is not None
    # Never part of the rows, never rows of two versions.
    assert seen and all(len(rows) == 1 and rows[0][1] == 200 for rows in seen)
    assert {r.version for r in early.collect()} == {0}
    assert {(r.version, r.part) for r in store.read("rows", schema).collect()} == {(4, k) for k in range(3)}
    store.insert_new_only(contents(9).withColumn("id", F.col("id") + 100), "rows", schema, "id")
    store.vacuum("rows", schema)
    assert {r.version: r.n for r in store.read("rows", schema).groupBy("version").agg(F.count("*").alias("n")).collect()} == {4: 200, 9: 100}
    assert store.layout("rows", schema) == Layout(partition_by, "id" if buckets else None, buckets)


@pytest.mark.parametrize("buckets", [0, 2])
def test_delete_leaves_untouched_partitions_alone(spark, store, schema, buckets):
    rows = spark.createDataFrame(
        [(k, f"v{k}", place) for k, place in enumerate(["a b", "a b", "c", "c", "d=%", None, None])], "id int, value string, place string"
    )
    store.create("t", schema, rows.schema, partition_by=("place",), bucket_by="id" if buckets else None, buckets=buckets)
    store.write(rows, "t", schema, mode="append")

    def files_of(condition):
        return {r[0] for r in store.read("t", schema).where(condition).select("_metadata.file_path").collect()}

    untouched = files_of("place = 'c'")
    # One partition goes whole, one with a sign in its name too, one in part, the null one in part.
    store.delete("t", schema, F.expr("place = 'a b' AND id = 0 OR place = 'd=%' OR place IS NULL AND id = 5"))
    assert sorted(r["id"] for r in store.read("t", schema).collect()) == [1, 2, 3, 6]
    assert files_of("place = 'c'") == untouched
    store.delete("t", schema, F.col("place") == "a b")
    store.delete("t", schema, F.col("id") > 100)
    assert sorted(r["id"] for r in store.read("t", schema).collect()) == [2, 3, 6]
    assert files_of("place = 'c'") == untouched
    assert store.layout("t", schema).partition_by == ("place",)
    store.delete("t", schema, F.lit(True))
    assert store.read("t", schema).count() == 0


def test_sorted_export(spark):
    rows = [(k * 7919 % 1000 if k % 10 else None, k) for k in range(2000)]
    df = spark.createDataFrame(rows, "score int, id int").repartition(5)
    folder = new_folder(spark, "sorted")
    files.export_sorted(df, folder, [F.desc_nulls_last("score"), F.asc("id")], files=4)
    got = [tuple(r) for r in files.read_sorted(spark, folder).orderBy("position").collect()]
    expected = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == [(k, *r) for k, r in enumerate(expected, 1)]
    listed = files.manifest(spark, folder).orderBy("number").collect()
    assert len(listed) == 4 and listed[-1]["before"] + listed[-1]["rows"] == 2000
    empty = new_folder(spark, "sorted")
    files.export_sorted(df.where("id < 0"), empty, [F.asc("id")])
    assert files.read_sorted(spark, empty).count() == 0
