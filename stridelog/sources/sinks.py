"""Writers: run reports as JSON lines, JSON or CSV, findings, review packets, labels.

Tables are written by the executors. Only the small, human-facing forms (a pretty JSON array, a corpus report) are made on the driver, from rows streamed to it.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT = (
    "instance_id", "framework", "resolved", "total_steps", "wasted_steps", "wasted_step_ratio", "n_findings", "by_category", "by_phase", "by_severity", "source_edits", "test_runs", "tests_per_source_edit", "test_run_ratio", "novel_observation_ratio",
)
CSV = ("instance_id", "framework", "resolved", "total_steps", "source_edits", "test_runs", "tests_per_source_edit", "test_run_ratio", "wasted_steps", "wasted_step_ratio", "n_findings")
_RATIOS = ("wasted_step_ratio", "tests_per_source_edit", "test_run_ratio", "novel_observation_ratio")


def export_rows(reports: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """``reports`` in the columns of the export, ratios to four places; with the runs' findings if given."""
    r = reports.select("run_key", *EXPORT).withColumns({c: F.round(c, 4) for c in _RATIOS})
    if findings is not None:
        f = F.struct("start", "category", "registry_ord", "emit_ord", F.struct("detector", "category", "phase", "severity", "start", "end", "wasted_steps", "evidence", "confidence", F.try_parse_json("detail").alias("detail")).alias("f"))
        own = findings.groupBy("run_key").agg(F.collect_list(f).alias("fs"))
        order: Column = F.array_sort("fs", lambda a, b: F.when(_key(a) < _key(b), -1).when(_key(a) > _key(b), 1).otherwise(0))
        r = r.join(own.select("run_key", F.transform(order, lambda x: x["f"]).alias("findings")), "run_key", "left")
    return r.drop("run_key")


def _key(x: Column) -> Column:
    return F.struct(x["start"], x["category"], x["registry_ord"], x["emit_ord"])


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_json(rows: DataFrame, file: str) -> int:
    """A pretty array in one local file, streamed row by row; the number of rows."""
    n = 0
    with open(file, "w", encoding="utf-8") as out:
        out.write("[")
        for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
            body = json.dumps(json.loads(r[0]), indent=2, ensure_ascii=False).replace("\n", "\n  ")
            out.write(("," if n else "") + "\n  " + body)
            n += 1
        out.write("\n]" if n else "]")
    return n


def csv_rows(reports: DataFrame) -> DataFrame:
    """The fixed columns, then one for each category that occurs, sorted; absent counts are blank."""
    reports = reports.select(*CSV, "by_category").persist()  # read for the names and the rows
    names = sorted(r.c for r in reports.select(F.explode(F.map_keys("by_category")).alias("c")).distinct().collect())  # at most one a rule
    rounded = reports.withColumns({c: F.round(c, 4) for c in _RATIOS if c in CSV})
    return rounded.select(*CSV, *(F.try_element_at("by_category", F.lit(c)).alias(c) for c in names))


def write_csv(reports: DataFrame, path: str) -> None:
    csv_rows(reports).write.option("header", True).csv(path)


def corpus_report(reports: DataFrame, config: dict | None = None) -> dict:
    """Outcome statistics, category rates and lift as one object; a few rows each."""
    from stridelog.operators.metrics import category_lift, category_stats, outcome_stats

    places = lambda k: 4 if "ratio" in k and "tests_per" not in k else 2
    groups = {r["label"]: {k: round(v, places(k)) if isinstance(v, float) else v for k, v in r.asDict().items()} | {"category_rate": {}, "mean_waste_by_category": {}} for r in outcome_stats(reports).collect()}
    for r in category_stats(reports).collect():
        groups[r.label]["category_rate"][r.category] = round(r.category_rate, 4)
        groups[r.label]["mean_waste_by_category"][r.category] = round(r.mean_waste, 2)
    overall = groups.pop("all", {"label": "all", "n": 0})
    lift = {r.category: round(r.lift, 4) for r in category_lift(reports).orderBy("category").collect()}
    return {"n_trajectories": overall["n"], "overall": overall, "by_outcome": groups, "category_lift_unresolved_minus_resolved": lift, "n_analysed": overall["n"], "config": config or {}}


def packets(review: DataFrame, code_sha256: str, raw_sha256: str) -> DataFrame:
    """Review packets: rows without the outcome, with the digests of code and data that they were made from."""
    hidden = [c for c in ("resolved", "resolved_raw", "exit_status") if c in review.columns]
    return review.drop(*hidden).withColumn("code_sha256", F.lit(code_sha256)).withColumn("raw_sha256", F.lit(raw_sha256))


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows whatever their order: a sum of row hashes, and how many."""
    a, b, n = df.agg(F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")), F.sum(F.hash(F.to_json(F.struct("*"))).cast("decimal(38,0)")), F.count("*")).first()
    return hashlib.sha256(f"{a}|{b}|{n}".encode()).hexdigest()


def write_labels(labels: DataFrame, path: str) -> bool:
    """Writes a label table once: the same content again is no change (False), other content is refused."""
    spark: SparkSession = labels.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        if content_digest(spark.read.schema(labels.schema).json(path)) != content_digest(labels):
            raise FileExistsError(f"{path} holds other labels")
        return False
    write_jsonl(labels, path)
    return True
