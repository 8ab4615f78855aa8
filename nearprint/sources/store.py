"""Reading and maintaining catalog tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearprint.operators.keyed import new_rows
from nearprint.storage import materialise

OVERWRITTEN = "spark.sql.sources.partitionOverwriteMode"
LISTED_PARTITIONS = "spark.sql.hive.manageFilesourcePartitions"


def qualified(table: str, schema: str) -> str:
    """A quoted two-part name, safe to put into SQL."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in (schema, table))


@dataclass(frozen=True)
class Layout:
    """Partition columns and buckets of a table."""

    partition_by: tuple[str, ...] = ()
    bucket_by: str | None = None
    buckets: int = 0

    def only(self, columns: list[str]) -> Layout:
        """The layout as far as these columns allow it."""
        kept = tuple(c for c in self.partition_by if c in columns)
        return Layout(kept, self.bucket_by, self.buckets) if self.bucket_by in columns else Layout(kept)

    def arranged(self, df: DataFrame) -> DataFrame:
        """Rows of one bucket in one task, so that a write adds one file to each bucket."""
        return df.repartition(self.buckets, self.bucket_by) if self.buckets else df

    def save(self, df: DataFrame, name: str, path: str | None = None) -> None:
        writer = self.arranged(df).write.format("parquet").partitionBy(*self.partition_by)
        if self.buckets:
            writer = writer.bucketBy(self.buckets, self.bucket_by)
        # The folders name the partitions.  A catalog that listed them, each with a place of its
        # own, could not move a table in one step.
        conf = df.sparkSession.conf
        before = conf.get(LISTED_PARTITIONS)
        conf.set(LISTED_PARTITIONS, "false")
        try:
            writer.saveAsTable(name, path=path) if path else writer.saveAsTable(name)
        finally:
            conf.set(LISTED_PARTITIONS, before)


class TableStore:
    """Tables of named schemas, each schema a database of the session catalog."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(
        self,
        table: str | None = None,
        schema: str | None = None,
        query: str | None = None,
        params: dict[str, Any] | None = None,
    ) -> DataFrame:
        """A whole table, or a query with ``:name`` parameters bound as typed values."""
        if table and query:
            raise ValueError("give a table or a query, not both")
        if table and not schema:
            raise ValueError("a table needs the schema it is in")
        if params and not query:
            raise ValueError("params belong to a query")
        if query:
            return self.spark.sql(query, args=params or None)
        if not table:
            raise ValueError("give a table or a query")
        return self.spark.table(qualified(table, schema))

    def columns(self, table: str, schema: str) -> list[str]:
        """Column names in stored order.  Runs no job; a missing table is an error."""
        return self.read(table, schema).columns

    def extreme(self, table: str, schema: str, which: str, column: str) -> Any:
        """The smallest (``min``) or largest (``max``) value of a column; None if empty."""
        return min_or_max(self.read(table, schema), which, column).first()[0]

    def contains(self, value: Any, table: str, schema: str, column: str) -> bool:
        """Whether any row holds the value."""
        return not self.read(table, schema).where(F.col(column) == F.lit(value)).limit(1).isEmpty()

    def execute(self, sql: str, params: dict[str, Any] | None = None) -> None:
        """Run a statement with ``:name`` parameters."""
        self.spark.sql(sql, args=params or None)

    def create(
        self,
        table: str,
        schema: str,
        columns: T.StructType,
        partition_by: tuple[str, ...] = (),
        bucket_by: str | None = None,
        buckets: int = 0,
    ) -> None:
        """Create an empty table unless it exists.  Partition columns come last in it.

        Tables bucketed alike by their key are anti-joined and joined where they lie: an
        incremental job then shuffles none of the rows that are already stored.
        """
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema.replace('`', '``')}`")
        if not self.spark.catalog.tableExists(qualified(table, schema)):
            layout = Layout(tuple(partition_by), bucket_by, buckets if bucket_by else 0)
            layout.save(self.spark.createDataFrame([], columns), qualified(table, schema))

    def layout(self, table: str, schema: str) -> Layout:
        """How the files of a table are laid out; the plain layout if there is no table."""
        name = qualified(table, schema)
        if not self.spark.catalog.tableExists(name):
            return Layout()
        partitions = tuple(c.name for c in self.spark.catalog.listColumns(name) if c.isPartition)
        described = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
        if "Num Buckets" not in described:
            return Layout(partitions)
        return Layout(partitions, described["Bucket Columns"].strip("[]`"), int(described["Num Buckets"]))

    def write(self, df: DataFrame, table: str, schema: str, mode: str = "fail") -> None:
        """Write a table: ``fail`` if it exists, ``append`` or ``replace``."""
        name = qualified(table, schema)
        if mode == "replace":
            self._swap(df, table, schema)
        elif mode == "append" and self.spark.catalog.tableExists(name):
            layout = self.layout(table, schema)
            layout.arranged(df.select(*self.columns(table, schema))).write.insertInto(name)
        elif mode in ("append", "fail"):
            Layout().save(df, name)
        else:
            raise ValueError(f"unknown mode {mode!r}: use fail, append or replace")

    def insert_new_only(
        self, df: DataFrame, table: str, schema: str, key: str | list[str], order: list[Column] | None = None
    ) -> None:
        """Append the rows whose key the table does not hold; stored rows stay as they are.

        Running it again with the same rows adds nothing, so a failed run is just repeated.
        """
        rows = new_rows(self.read(table, schema), df, key, order)
        self.layout(table, schema).arranged(rows).write.insertInto(qualified(table, schema))

    def replace(self, df: DataFrame, table: str, schema: str) -> None:
        """Replace the contents and keep the columns, also when ``df`` reads the table."""
        wanted = self.read(table, schema).schema
        self._swap(df.select(*[F.col(f.name).cast(f.dataType) for f in wanted]), table, schema)

    def delete(self, table: str, schema: str, condition: Column) -> None:
        """Delete the rows for which the condition is true (not those where it is null).

        Of a partitioned table only the partitions that hold such a row are written anew; the
        files of all others stay.  Without partitions the whole table is.  A delete that was cut
        off is finished by the same call.
        """
        rows, gone = self.read(table, schema), F.coalesce(condition, F.lit(False))
        layout = self.layout(table, schema)
        if layout.partition_by:
            self._delete_in_partitions(rows, gone, layout, table, schema)
        else:
            self._swap(rows.where(~gone), table, schema)

    def _delete_in_partitions(self, rows: DataFrame, gone: Column, layout: Layout, table: str, schema: str) -> None:
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        marked = rows.select("*", gone.alias("__gone"), folder.alias("__folder"))
        counts = marked.groupBy(*layout.partition_by, "__folder").agg(
            F.count_if("__gone").alias("__n_gone"), F.count_if(~F.col("__gone")).alias("__n_left")
        )
        # A row for each partition at most.
        touched = materialise(counts.where(F.col("__n_gone") > 0), "touched")
        emptied = [r["__folder"] for r in touched.where("__n_left = 0").select("__folder").collect()]
        mixed = touched.where("__n_left > 0").select(*[F.col(c).alias(f"__{c}") for c in layout.partition_by])
        if not mixed.isEmpty():
            same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in layout.partition_by])
            left = rows.where(~gone).join(mixed, same, "left_semi")
            conf = self.spark.conf
            before = conf.get(OVERWRITTEN)
            conf.set(OVERWRITTEN, "dynamic")
            try:
                layout.arranged(left).write.insertInto(qualified(table, schema), overwrite=True)
            finally:
                conf.set(OVERWRITTEN, before)
        jvm = self.spark._jvm
        for folder in emptied:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.spark.catalog.refreshTable(qualified(table, schema))

    def recover(self, table: str, schema: str) -> None:
        """Finish a swap that was cut off between its two renames."""
        name, old = qualified(table, schema), qualified(f"{table}__old", schema)
        if self.spark.catalog.tableExists(old):
            if self.spark.catalog.tableExists(name):
                self.spark.sql(f"DROP TABLE {old}")
            else:
                self.spark.sql(f"ALTER TABLE {old} RENAME TO {name}")

    def location(self, table: str, schema: str) -> str:
        """The folder that holds the table's files."""
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {qualified(table, schema)}").where("col_name = 'Location'")
        return described.first()["data_type"]

    def vacuum(self, table: str, schema: str) -> None:
        """Delete the files of earlier contents.  Call it when no reader of them is left."""
        current = self.location(table, schema).rstrip("/").rpartition("/")[2]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(table, schema))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in files.listStatus(path) if files.exists(path) else []:
            if found.getPath().getName() != current:
                files.delete(found.getPath(), True)

    def _folder(self, table: str, schema: str) -> str:
        """Where contents that have replaced others lie, each in a folder of its own."""
        described = self.spark.sql(f"DESCRIBE DATABASE `{schema.replace('`', '``')}`").where("info_name = 'Location'")
        return f"{described.first()['info_value'].rstrip('/')}/__contents/{table}"

    def _swap(self, df: DataFrame, table: str, schema: str) -> None:
        # Written to a folder of its own first, as df may read the table, which then moves there in
        # one catalog call.  A reader that has listed the old files finds them still.
        name, aside = qualified(table, schema), qualified(f"{table}__next", schema)
        self.recover(table, schema)
        self.spark.sql(f"DROP TABLE IF EXISTS {aside}")
        path = f"{self._folder(table, schema)}/{uuid.uuid4().hex}"
        self.layout(table, schema).only(df.columns).save(df, aside, path)
        written, exists = self.spark.table(aside).schema, self.spark.catalog.tableExists(name)
        if exists and written.simpleString() == self.spark.table(name).schema.simpleString():
            self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
            self.spark.sql(f"DROP TABLE {aside}")
            self.spark.catalog.refreshTable(name)
            return
        # Other columns make another table: there is none in the moment between two renames.
        old = qualified(f"{table}__old", schema)
        if exists:
            self.spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
        self.spark.sql(f"ALTER TABLE {aside} RENAME TO {name}")
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        self.spark.catalog.refreshTable(name)


def min_or_max(df: DataFrame, which: str, column: str) -> DataFrame:
    """One row with the smallest or largest value, named after the function."""
    if which not in ("min", "max"):
        raise ValueError(f"{which!r} is neither min nor max")
    return df.agg(getattr(F, which)(column).alias(which))
