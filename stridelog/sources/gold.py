"""Reference solutions: which files the accepted patch of an instance touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelog.functions.diff import patch_files

from .records import numbered, read_records


def gold_of(records: DataFrame) -> DataFrame:
    """instance_id, files from records with ``files`` or ``patch``. Of repeated ids the last record counts; one without an id is an error."""
    r = numbered(records).select("file", "pos", F.from_json("record", "instance_id string, files array<string>, patch string").alias("g"))
    r = r.select(
        F.when(F.coalesce("g.instance_id", F.lit("")) != "", F.col("g.instance_id")).otherwise(F.raise_error(F.lit("a gold record has no instance_id")).cast("string")).alias("instance_id"),
        F.struct("file", "pos").alias("at"), F.col("g.files").alias("files"), F.col("g.patch").alias("patch"),
    )
    last = r.groupBy("instance_id").agg(F.max_by(F.struct("files", "patch"), "at").alias("g"))
    return last.withColumn("_files", patch_files(F.col("g.patch"))).select("instance_id", F.coalesce("g.files", "_files").alias("files"))


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    return gold_of(read_records(spark, path, lines=True))


def attach_gold(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """``runs`` with gold_files of their instance; none known, or an empty list: an empty array. The plan broadcasts ``gold`` only if its size allows it."""
    g = gold.select(F.col("instance_id").alias("_i"), F.col("files").alias("_files"))
    joined = runs.drop("gold_files").join(g, F.col("instance_id") == F.col("_i"), "left")
    return joined.withColumn("gold_files", F.coalesce("_files", F.array().cast("array<string>"))).drop("_i", "_files")


def gold_coverage(runs: DataFrame) -> DataFrame:
    """trajectories, attached, ratio."""
    out = runs.agg(F.count("*").alias("trajectories"), F.count_if(F.size("gold_files") > 0).alias("attached"))
    return out.withColumn("ratio", F.coalesce(F.try_divide("attached", "trajectories"), F.lit(0.0)))


def gold_rows(patches: DataFrame) -> DataFrame:
    """A sidecar from instance_id, repo, patch: files, the patch's length and the first 16 digits of its SHA-256."""
    p = F.coalesce("patch", F.lit(""))
    return patches.select("instance_id", "repo", patch_files(F.col("patch")).alias("files"), F.length(p).alias("patch_chars"), F.left(F.sha2(p.cast("binary"), 256), F.lit(16)).alias("patch_sha256_16"))
