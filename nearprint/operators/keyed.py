"""Set, filter and dedupe operators on keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def unprocessed(source: DataFrame, done: DataFrame, key: str | list[str], done_key: str | None = None) -> DataFrame:
    """Rows of ``source`` whose key, of one column or several, is not in ``done``.  Keys are not null."""
    known = done.select(*key) if isinstance(key, list) else done.select(F.col(done_key or key).alias(key))
    return source.join(known, key, "left_anti")


def not_in(source: DataFrame, target: DataFrame, key: str, target_key: str | None = None) -> DataFrame:
    """``key NOT IN (SELECT target_key FROM target)`` with SQL's treatment of nulls.

    A null among the target keys lets nothing pass; a null key passes only if the target
    is empty.  Written as an anti-join and one scalar, so that the target need not be
    broadcast.
    """
    keys = target.select(F.col(target_key or key).alias(key))
    state = keys.agg(F.struct(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("nulls"))).scalar()
    passes = (state["nulls"] == 0) & (F.col(key).isNotNull() | (state["rows"] == 0))
    return source.where(passes).join(keys, key, "left_anti")


def contained(source: DataFrame, target: DataFrame, key: str, target_key: str | None = None) -> DataFrame:
    """Rows of ``source`` whose key exists in ``target``."""
    return source.join(target.select(F.col(target_key or key).alias(key)), key, "left_semi")


def exists(df: DataFrame, condition: Column, name: str = "exists") -> DataFrame:
    """One row: whether any row satisfies the condition.  Each task stops at its first match."""
    return df.where(condition).limit(1).agg((F.count(F.lit(1)) > 0).alias(name))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key.  Every map task forwards one row per key at most."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return keep_first(df, keys, [F.desc(c) for c in order])


def newest(df: DataFrame, timestamp: str, n: int, tie: str) -> DataFrame:
    """The ``n`` most recent rows; rows without a timestamp come first."""
    return df.orderBy(F.col(timestamp).desc_nulls_first(), F.col(tie)).limit(n)


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any column (of ``subset``)."""
    return df.na.drop("any", subset=subset)


def concat(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; a column a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def new_rows(
    target: DataFrame, batch: DataFrame, key: str | list[str], order: list[Column] | None = None
) -> DataFrame:
    """Rows of ``batch`` to insert into ``target``: unknown keys, first row of each.

    Columns may come in any order but must be those of the target.  Without ``order`` the
    smallest row of a key is its first.
    """
    check_columns(batch.columns, target.columns)
    keys = [key] if isinstance(key, str) else list(key)
    fresh = batch.na.drop("any", subset=keys).join(target.select(*keys), keys, "left_anti")
    others = [F.asc(c) for c in target.columns if c not in keys]
    return keep_first(fresh, keys, order or others or [F.asc(c) for c in keys]).select(*target.columns)


def merge_new_rows(
    target: DataFrame, batch: DataFrame, key: str | list[str], order: list[Column] | None = None
) -> DataFrame:
    """``target`` after inserting new rows; rows it already holds are untouched."""
    return target.unionByName(new_rows(target, batch, key, order))


def column_difference(given: list[str], wanted: list[str]) -> list[str]:
    """The names that only one of the two holds, in order."""
    return sorted(set(given) ^ set(wanted))


def check_columns(given: list[str], wanted: list[str]) -> None:
    """Raise unless both hold the same column names, in any order."""
    difference = column_difference(given, wanted)
    if difference:
        raise ValueError(f"columns differ from those of the table: {', '.join(difference)}")


def merge_vertices(vertices: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(merged, conflicts)`` of creating vertices under a unique id.

    A vertex equal to a stored one is left alone.  One that has a stored id but other
    properties cannot be created; it is returned as a conflict, as is the second of two
    different new vertices with one id.
    """
    columns = vertices.columns
    properties = [c for c in columns if c != "id"]
    offered = batch.select(*columns).distinct()
    rows = concat([vertices.withColumn("_old", F.lit(0)), offered.withColumn("_old", F.lit(1))])
    merged = keep_first(rows, ["id"], [F.asc("_old"), *map(F.asc, properties)]).select(*columns)
    kept = merged.select("id", F.struct(*properties).alias("_kept"))
    conflicts = offered.join(kept, "id").where(~F.struct(*properties).eqNullSafe(F.col("_kept"))).select(*columns)
    return merged, conflicts
