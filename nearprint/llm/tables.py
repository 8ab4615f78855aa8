"""Small things the operators share: intermediate tables, bucket counts, row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearprint.storage import materialise, new_folder

__all__ = ["buckets", "doc_key", "documents", "materialise", "new_folder", "own_names", "with_key"]

LAST = 2**63 - 1


def buckets(spark: SparkSession) -> int:
    """How many pieces work is dealt into, as the session sets it for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def own_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``docs`` is called the same in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def doc_key(id_column: str = "doc_id") -> Column:
    """The id as a number that orders null after all others."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(LAST))


def with_key(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, mark, text)``: the id, null as the largest number, and a hash of the text.

    Rows that repeat both id and text share ``(doc, mark)`` and get the same result each;
    rows that repeat an id with another text count as other documents.
    """
    return docs.select(
        doc_key(id_column).alias("doc"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text")
    )
