"""Run logs as a stream: a record is a whole run, so the parse keeps no state; events of running agents keep a little for each run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stridelog.sources.adapters import loaded, parsed


def stream_records(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of JSON-lines files that appear under ``path``; run_key names the file and the record's content, as a stream has no row numbers."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).filter(F.col("value").rlike(r"\S"))
    file = F.col("_metadata.file_path")
    return raw.select(F.concat_ws("#", file, F.sha2("value", 256)).alias("run_key"), file.alias("file"), F.lit(0).cast("long").alias("block"), F.xxhash64("value").alias("ord"), F.col("value").alias("record"))


def stream_steps(spark: SparkSession, path: str, framework: str | None = None, **options) -> DataFrame:
    return loaded(parsed(stream_records(spark, path, **options), framework))[1]


def each_batch(records: DataFrame, checkpoint: str, sink: Callable[[DataFrame, DataFrame, DataFrame, int], None], framework: str | None = None, **trigger) -> StreamingQuery:
    """Parses, diagnoses and hands (runs, steps, findings, batch's number) of each micro-batch to ``sink``. A batch that is run again has the same number.

    A record that a file repeats within a batch is one run: its steps aren't mixed with those of its copies.
    """
    from stridelog.operators.detectors import detect_all

    def batch(df: DataFrame, number: int) -> None:
        runs, steps = loaded(parsed(df.dropDuplicates(["run_key"]), framework), on_empty="warn")
        sink(runs, steps, detect_all(steps, runs), number)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def activity(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each kind in windows; what comes more than ``late`` behind is dropped and closed windows leave the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")
