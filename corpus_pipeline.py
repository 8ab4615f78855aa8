"""From raw documents to packed sequences.

Every stage is a Spark job over all that the one before it kept.  All but the last return the
columns of ``documents``; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearprint.llm import lines, mixing, neardup, packing, quality
from nearprint.llm.tables import materialise, own_names

#: Near copies share 0.8 of their five-word shingles.  Of two such sets, fewer than half of the
#: 64 sketch values are common with a chance of 2e-8.
NEAR_PERCENT = 80
NEAR_FLOOR = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labels draws."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; documents of which no word is left go.

    ``n_chars`` follows the text.  A text that had no word before stays as it is.
    """
    n_lines, n_removed = own_names(docs, "n_lines", "n_removed")
    kept = lines.dedup(docs, counts=(n_lines, n_removed))
    removed = F.col(n_removed) > 0
    emptied = removed & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = kept.where(~emptied).withColumn("n_chars", F.when(removed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return neardup.keep_one(docs, percent=NEAR_PERCENT, floor=NEAR_FLOOR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a row for each time."""
    copies = mixing.mix(docs).select("doc_id", (F.col("whole") + F.col("extra")).alias("copies"))
    return mixing.sample(docs, copies)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of 4,096 ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

# Tokenising, hashed n-gram models and sketches are beyond SQL: tests/llm compares the stages
# with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
