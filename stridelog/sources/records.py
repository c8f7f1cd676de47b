"""Raw run logs: one JSON object per run, in JSON-lines files or in whole files that hold an object or a list of objects.

A record keeps its JSON text; nothing is parsed twice over a shuffle and no schema is inferred, since records of one file may differ in shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BOM = "\ufeff"


def _checked(value: Column, strict: bool) -> Column:
    """The text if it is JSON; else an error that names the place, or null."""
    bad = F.concat(F.lit("invalid JSON record: "), F.col("file"), F.lit(" near byte "), F.col("block").cast("string"))
    return F.when(F.try_parse_json(value).isNotNull(), value).otherwise(F.raise_error(bad).cast("string") if strict else F.lit(None).cast("string"))


def read_records(spark: SparkSession, path: str | list[str], strict: bool = True, lines: bool | None = None) -> DataFrame:
    """run_key, file, block, ord, record of every record under ``path``.

    Files that end in .jsonl are read line by line (``lines`` forces either way), others whole: a list in one gives a record for each element.
    (file, block, ord) is the order in which records are stored; run_key names the place. Blank lines and a byte-order mark are skipped. A record that isn't
    JSON stops the query, or is left out if not ``strict``. NaN and repeated keys are no JSON here.
    """
    paths = [path] if isinstance(path, str) else list(path)
    by_line = all(p.rstrip("/").endswith((".jsonl", ".jsonl.gz")) for p in paths) if lines is None else lines
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = spark.read.text(paths, wholetext=not by_line).select(*place, F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", f"\\A{_BOM}", "").alias("record"))
    raw = raw.filter(F.col("record").rlike(r"\S"))
    if not by_line:
        parts = F.when(F.ltrim("record").startswith("["), F.from_json("record", "array<string>")).otherwise(F.array("record"))
        raw = raw.select("file", "block", F.posexplode(F.coalesce(parts, F.array("record"))).alias("ord", "record")).withColumn("ord", F.col("ord").cast("long"))
    out = raw.withColumn("record", _checked(F.col("record"), strict))
    if not strict:
        out = out.filter("record IS NOT NULL")
    # the partition's number in the upper bits of ord differs between cluster settings; what is left numbers the records of one block
    return out.select(F.concat_ws("#", "file", "block", F.col("ord").bitwiseAND(F.lit((1 << 33) - 1)).cast("string")).alias("run_key"), "file", "block", "ord", "record")


def numbered(records: DataFrame) -> DataFrame:
    """``records`` with ``pos``, from 0 in each file: row numbers inside each block plus the rows of the blocks before it. Texts are not moved for the totals."""
    sizes = records.groupBy("file", "block").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("ord"))
    return records.withColumn("pos", own - 1).join(sizes, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))).withColumn("pos", F.col("pos") + F.col("_ahead")).drop("_f", "_b", "_ahead")


def from_table(df: DataFrame, record: str, key: str) -> DataFrame:
    """Records held in a column of a table (a stream may be one); ``key`` orders and names them."""
    k = F.col(key).cast("string")
    return df.select(k.alias("run_key"), F.lit("table").alias("file"), F.lit(0).cast("long").alias("block"), F.xxhash64(k).alias("ord"), F.col(record).cast("string").alias("record"))


def wanted(records: DataFrame) -> DataFrame:
    """instance_id, first place: the distinct instances of ``records`` in stored order."""
    return records.select(F.get_json_object("record", "$.instance_id").alias("instance_id"), F.struct("file", "block", "ord").alias("at")).groupBy("instance_id").agg(F.min("at").alias("at")).orderBy("at").select("instance_id")


def parquet_subset(spark: SparkSession, path: str, columns: list[str], ids: DataFrame, key: str = "instance_id", order: str | None = None) -> DataFrame:
    """``columns`` of the rows whose ``key`` is in ``ids``, one row for each: the first by ``order`` (default: by the columns themselves)."""
    names = list(dict.fromkeys([key, *columns, *([order] if order else [])]))
    rows = spark.read.parquet(path).select(*names).join(ids.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")
    first = F.min_by(F.struct(*columns), F.col(order) if order else F.struct(*columns))
    return rows.groupBy(key).agg(first.alias("_row")).select(key, *(F.col("_row")[c].alias(c) for c in columns if c != key))


def to_json_lines(df: DataFrame, path: str, files: int | None = None) -> None:
    """Rows as JSON objects, one a line."""
    out = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    (out.coalesce(files) if files else out).write.text(path)


def class_quota(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each class in order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_nth") <= most).drop("_nth")
