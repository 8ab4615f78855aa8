"""The operators applied to the whole ``documents`` table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearprint.llm import fingerprints, idstore, lines, mixing, neardup, packing, pii, quality, resample, rules, substrings, suffixes, variants
from nearprint.llm.tables import documents

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    keys, cut = quality.select(docs, quality.fit(docs, labels))
    return keys.select("doc_id", "weight", (F.col("key") >= cut).alias("kept"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idstore.encode_and_read(documents(spark, sf_dir))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(documents(spark, sf_dir))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(documents(spark, sf_dir))


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(documents(spark, sf_dir))


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(documents(spark, sf_dir))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply(documents(spark, sf_dir))


@query
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


@query
def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = resample.importance(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(documents(spark, sf_dir))
