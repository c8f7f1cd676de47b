"""Ranks and running sums over a whole table, without a task that holds it.

Scores are cut into ranges at approximate quantiles; where the cuts lie only decides how even the ranges are. Sums of the ranges are few rows, so their running sums are cheap,
and a window inside each range does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def _cuts(score: Column, buckets: int) -> Column:
    return F.percentile_approx(score, F.expr(f"array({', '.join(f'{k / buckets}D' for k in range(1, buckets))})"))


def sums_below(df: DataFrame, group: str, score: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` (one row for each group and score) with ``below``: the sum of ``value`` over lower scores of its group. Groups should be few."""
    cuts = df.groupBy(F.col(group).alias("_g")).agg(_cuts(F.col(score), buckets).alias("_cuts"))
    dealt = df.join(F.broadcast(cuts), F.col(group).eqNullSafe(F.col("_g"))).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(score)))).drop("_g", "_cuts")
    ahead = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranges = dealt.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_r")).agg(F.sum(value).alias(value))  # at most `buckets` a group
    ranges = ranges.select("_g", "_r", ahead(Window.partitionBy("_g").orderBy("_r")).alias("_before"))
    own = dealt.withColumn("below", ahead(Window.partitionBy(group, "_b").orderBy(score)))
    return own.join(F.broadcast(ranges), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_r"))).withColumn("below", F.col("below") + F.col("_before")).drop("_b", "_g", "_r", "_before")


def numbered_from_top(df: DataFrame, score: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``nth`` from 1, highest score first; equal scores in the order of their keys' SHA-256.

    A score that many rows share is a cut itself: its rows are a range of their own, dealt once more by their hash.
    """
    cuts = df.agg(_cuts(F.col(score), buckets).alias("_cuts"))
    h = F.sha2(F.col(key).cast("string").cast("binary"), 256)
    dealt = df.withColumn("_h", h).join(F.broadcast(cuts))
    above, at = F.size(F.filter("_cuts", lambda c: c > F.col(score))), F.array_contains("_cuts", F.col(score))
    dealt = dealt.withColumn("_b", F.when(at, F.struct((2 * above).alias("b"), F.left("_h", F.lit(2)).alias("s"))).otherwise(F.struct((2 * above + 1).alias("b"), F.lit("").alias("s")))).drop("_cuts")
    # at most 257 ranges, and 256 parts of each that is one score
    sizes = dealt.groupBy(F.col("_b").alias("_r")).agg(F.count("*").alias("_n"))
    sizes = sizes.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("_b").orderBy(F.desc(score), "_h", key)))
    return own.join(F.broadcast(sizes), F.col("_b") == F.col("_r")).withColumn("nth", F.col("nth") + F.col("_before")).drop("_b", "_r", "_h", "_before")
