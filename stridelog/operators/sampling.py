"""Deterministic draws: rows are ordered by a hash of the seed and their key, so a draw doesn't depend on partitions and grows with no state.

Draws from groups rank inside the group with a row limit, which Spark applies before and after the exchange, so a hot group sends few rows to its task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(keys: Sequence[str], seed: int) -> Column:
    """The hexadecimal SHA-256 of the seed and the key: the same in any engine."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)), 256)


def uniform(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement."""
    return df.withColumn("_draw", draw_key(keys, seed)).orderBy("_draw", *keys).limit(n).drop("_draw")


def capped(df: DataFrame, by: Sequence[str], keys: Sequence[str], most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each group."""
    w = Window.partitionBy(*by).orderBy("_draw", *keys)
    return df.withColumn("_draw", draw_key(keys, seed)).withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= most).drop("_draw", "_nth")


def length_band(n: Column, bounds: Sequence[tuple[str, int]] = (("short", 40), ("medium", 120)), rest: str = "long") -> Column:
    out = F.lit(rest)
    for name, below in reversed(list(bounds)):
        out = F.when(n < below, name).otherwise(out)
    return out


def stratified(df: DataFrame, outcome: Column, length: Column, keys: Sequence[str], per_stratum: int, seed: int = 0) -> DataFrame:
    """Up to ``per_stratum`` rows of each outcome and length band, with ``stratum``."""
    return capped(df.withColumn("stratum", F.concat_ws("/", outcome, length_band(length))), ["stratum"], keys, per_stratum, seed)


def expand(pool: DataFrame, existing: DataFrame, keys: Sequence[str], outcome: str, instance: str, order: str, n: int, per_instance: int, seed: int = 0) -> DataFrame:
    """New rows for a sample: not yet in ``existing``, at most ``per_instance`` of an instance (the first in ``order``), ``n`` // 2 of each outcome."""
    new = pool.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    first = Window.partitionBy(instance).orderBy(order)
    new = new.withColumn("_of", F.row_number().over(first)).filter(F.col("_of") <= per_instance).drop("_of")
    return capped(new.filter(F.col(outcome).isNotNull()), [outcome], keys, n // 2, seed)


def head_and_tail(df: DataFrame, by: Sequence[str], order: str, rows: int) -> DataFrame:
    """The first and last ``rows`` // 2 of each group; all if it has no more than ``rows`` or ``rows`` is below 2."""
    if rows < 2:
        return df
    up, down = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by).orderBy(F.desc(order))
    d = df.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down))
    return d.filter((F.col("_u") + F.col("_d") - 1 <= rows) | (F.col("_u") <= rows // 2) | (F.col("_d") <= rows // 2)).drop("_u", "_d")


def last_steps(steps: DataFrame, n: int = 8) -> DataFrame:
    w = Window.partitionBy("run_key").orderBy(F.desc("idx"))
    return steps.withColumn("_d", F.row_number().over(w)).filter(F.col("_d") <= n).drop("_d")


def review_rows(findings: DataFrame, steps: DataFrame, around: int = 3, obs_chars: int = 400) -> DataFrame:
    """Findings with ``context``, the steps around them, projected for a reviewer. Outcomes take no part."""
    from stridelog.functions.text import action_summary, compact

    size = F.length(F.coalesce(F.nullif("new_str", F.lit("")), F.nullif("file_text", F.lit("")), F.lit("")))
    s = steps.select(
        F.col("run_key").alias("_r"), "idx", "kind", action_summary(160).alias("action"), F.get("files_touched", F.lit(0)).alias("path"), "view_range", F.nullif(size, F.lit(0)).alias("edit_bytes"), F.col("verb").alias("edit_verb"),
        compact("observation", obs_chars).alias("observation"), "error_kind",
    )
    keys = findings.columns
    near = findings.join(s, (F.col("run_key") == F.col("_r")) & F.col("idx").between(F.col("start") - around, F.col("end") + around))
    step = F.struct("idx", "kind", "action", F.col("path"), "view_range", "edit_bytes", "edit_verb", "observation", "error_kind", F.array_contains("wasted_steps", F.col("idx")).alias("is_wasted"))
    return near.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("context"))
