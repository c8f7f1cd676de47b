"""Contiguous shards of equal bytes from global prefix sums (native).

Rows are put in a total order and dealt into range partitions. Each partition reports
one row with its bytes and row count; a prefix sum over those few rows gives every partition the
bytes and rows that lie before it, and a window inside the partition gives every row its own
global prefix. Cutting that prefix at equal targets yields contiguous shards whose sizes
differ from the target by less than one row. Only sizes and keys are shuffled, never the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def global_prefix(df: DataFrame, order_by: list[str], size: str) -> DataFrame:
    """Adds ``_before`` (bytes of all earlier rows), ``_index`` (rows earlier) and ``_total``.

    ``df`` should be narrow. The order is ``order_by``, nulls first; ties are broken by a row number
    given once and stored, so repeated rows get distinct, stable places. Null sizes count as 0.
    A key that a third of the rows share is spread over partitions by that row number.
    """
    rows = materialize(df.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0))).withColumn("_row", F.monotonically_increasing_id()), "sizes")
    order = [F.col(c).asc_nulls_first() for c in order_by] + [F.col("_row").asc()]
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    # one row for each partition: their number is the shuffle's, whatever the rows
    parts = dealt.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    parts = parts.select(
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows0"),
        F.sum("_bytes").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        dealt.withColumn("_sum", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_nth", F.row_number().over(inside).cast("long"))
        .join(F.broadcast(parts), F.col("_part") == F.col("_p"))
        .withColumn("_before", F.col("_bytes0") + F.col("_sum") - F.col("_size"))
        .withColumn("_index", F.col("_rows0") + F.col("_nth") - 1)
        .drop("_p", "_sum", "_nth", "_bytes0", "_rows0", "_row", "_part")
    )


def shard_by_bytes(df: DataFrame, shards: int, order_by: list[str], size: str) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    A row goes to the shard in which its middle byte falls, so every shard's size is within one row
    of the target. An empty table gives an empty result; if all sizes are 0 every row is in
    shard 0. Columns of ``df`` other than these must not begin with an underscore or be named
    ``shard`` or ``slot``.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    placed = global_prefix(df, order_by, size)
    middle = F.expr(f"((2 * _before + _size) * {int(shards)}L) div greatest(2 * _total, 1L)")
    placed = placed.withColumn("shard", F.least(middle, F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first")).withColumnRenamed("shard", "_shard")
    return (
        placed.join(F.broadcast(first), F.col("shard") == F.col("_shard"))
        .withColumn("slot", F.col("_index") - F.col("_first"))
        .drop("_shard", "_first", "_before", "_index", "_total", "_size")
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The contract's digest: doc_id, size, text_crc32, law, shard, int, slot, grown_shard.

    Size: UTF-8 bytes of the text (null: none) plus 8. Other columns of ``docs`` are ignored.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_by_bytes(narrow, shards, ["doc_id", "text_crc32", "size"], "size").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
