"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import roundtrip

    return roundtrip(_table(spark, sf_dir, "pages"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .permutation import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op5_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op8_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_digest

    return pii_digest(_table(spark, sf_dir, "documents"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ordinal_quality, op2_warc_zip, op3_permutation_index, op4_secret_forest, op5_simhash_pigeonhole, op6_byte_shards, op7_best_fit, op8_bucket_pointers, op9_bootstrapped_pii, op10_spaced_seeds)}


def oracle_sql() -> dict[str, str]:
    return {}
