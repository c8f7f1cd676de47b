"""Precision of the rules: stored verdicts joined to what the rules report now.

A label carries finding_id, verdict and reason, and may carry finding_signature and detector. Live findings carry finding_id, finding_signature,
legacy_finding_id, detector, confidence. Both tables are joined by id; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERDICTS = ("valid", "invalid", "uncertain")
BANDS = (0.0, 0.6, 0.7, 0.8, 0.9, 1.01)
CUTOFFS = (0.0, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of all files that ``path`` (a glob) names; of repeated ids the last in file and line order counts."""
    from stridelog.sources.records import numbered, read_records

    r = numbered(read_records(spark, path, lines=True)).select("file", "pos", F.from_json("record", "finding_id string, verdict string, reason string, finding_signature string, detector string").alias("l"))
    return r.groupBy("l.finding_id").agg(F.max_by("l", F.struct("file", "pos")).alias("l")).select("l.*")


def match_labels(live: DataFrame, labels: DataFrame, allow_legacy: bool = False) -> DataFrame:
    """Every label with ``state``: matched, legacy_matched or stale; matched ones with the live finding's columns.

    Ids of the current version match exactly and, where the label carries one, by signature. Older ids match by run and place only if ``allow_legacy`` and
    a single live finding has them. ``rejected_legacy``: an older id that wasn't matched so.
    """
    names = ["finding_id", "finding_signature", "legacy_finding_id", "detector", "confidence", "evidence", "run_key", "start"]
    row = F.struct(*(n for n in names if n in live.columns))
    exact = live.select(F.col("finding_id").alias("_id"), row.alias("_exact"))
    lab = labels.withColumnsRenamed({c: f"l_{c}" for c in labels.columns})
    for c in ("finding_signature", "detector", "reason"):
        if f"l_{c}" not in lab.columns:
            lab = lab.withColumn(f"l_{c}", F.lit(None).cast("string"))
    out = lab.join(exact, F.col("l_finding_id") == F.col("_id"), "left")
    old = ~F.startswith(F.col("l_finding_id"), F.lit("v2|"))
    if allow_legacy:
        by_place = live.groupBy(F.col("legacy_finding_id").alias("_old")).agg(F.count("*").alias("_n"), F.min(row).alias("_legacy")).filter("_n = 1")
        out = out.join(by_place, old & F.col("_exact").isNull() & (F.col("l_finding_id") == F.col("_old")), "left")
        legacy = F.col("_legacy")
    else:
        legacy = F.lit(None).cast(exact.schema["_exact"].dataType)
    out = out.withColumn("_row", F.coalesce("_exact", legacy)).withColumn("_by_place", F.col("_exact").isNull() & legacy.isNotNull())
    agrees = F.col("_row").isNotNull() & (F.col("l_finding_signature").isNull() | F.col("l_finding_signature").eqNullSafe(F.col("_row.finding_signature")))
    parts = F.split("l_finding_id", r"\|")
    named = F.coalesce(F.nullif("l_detector", F.lit("")), F.when(old, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(2))))
    return out.select(
        F.col("l_finding_id").alias("label_id"), F.col("l_verdict").alias("verdict"), F.coalesce("l_reason", F.lit("")).alias("reason"), F.when(agrees & F.col("_by_place"), "legacy_matched").when(agrees, "matched").otherwise("stale").alias("state"),
        (old & F.col("_exact").isNull() & ~F.col("_by_place")).alias("rejected_legacy"), F.coalesce(F.when(agrees, F.col("_row.detector")), named).alias("detector"), F.when(agrees, F.col("_row.confidence")).alias("confidence"), F.when(agrees, F.col("_row.finding_id")).alias("finding_id"),
    )


def joined(matches: DataFrame) -> DataFrame:
    return matches.filter("state <> 'stale'")


def stale_labels(matches: DataFrame) -> DataFrame:
    """detector, n of labels that no live finding answers."""
    return matches.filter("state = 'stale'").groupBy("detector").agg(F.count("*").alias("n"))


def coverage(live: DataFrame, matches: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """One row of counts; stale labels are counted, never scored."""
    m = matches.agg(
        F.count("*").alias("labels"), F.count_if(F.col("state") != "stale").alias("matched"), F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "legacy_matched").alias("legacy_matched"),
        F.count_if("rejected_legacy").alias("rejected_legacy"),
    )
    out = m.join(F.broadcast(live.agg(F.count("*").alias("live"))))  # one row each
    out = out.join(F.broadcast(duplicates)) if duplicates is not None else out.withColumn("duplicate_ids", F.lit(0).cast("long"))
    return out.withColumn("unlabelled", F.col("live") - F.col("matched"))


def _score(valid: Column, invalid: Column) -> Column:
    return F.coalesce(F.try_divide(valid, valid + invalid), F.lit(float("nan")))


def _tally(df: DataFrame, *keys: str) -> DataFrame:
    v, i = F.count_if(F.col("verdict") == "valid"), F.count_if(F.col("verdict") == "invalid")
    out = df.groupBy(*keys).agg(v.alias("valid"), i.alias("invalid"))
    return out.withColumn("n", F.col("valid") + F.col("invalid"))


def precision_by_detector(rows: DataFrame, every: Sequence[str] | None = None) -> DataFrame:
    """detector, n, valid, invalid, precision (NaN without scored labels). ``every``: names that are listed even if nothing is labelled."""
    t = _tally(rows, "detector")
    if every is not None:
        names = rows.sparkSession.createDataFrame([(n,) for n in every], "name string")
        t = names.join(t, F.col("name") == F.col("detector"), "full_outer").select(F.coalesce("name", "detector").alias("detector"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("valid", "invalid", "n")))
    return t.select("detector", "n", "valid", "invalid", _score(F.col("valid"), F.col("invalid")).alias("precision"))


def confidence_bands(rows: DataFrame, bounds: Sequence[float] = BANDS) -> DataFrame:
    """lo, hi, n, valid, invalid, precision of the half-open bands that hold a scored label."""
    pairs = list(zip(bounds[:-1], bounds[1:], strict=True))
    lo = F.lit(None).cast("double")
    for a, b in reversed(pairs):
        lo = F.when((F.col("confidence") >= a) & (F.col("confidence") < b), F.lit(float(a))).otherwise(lo)
    t = _tally(rows.withColumn("lo", lo).filter("lo IS NOT NULL"), "lo").filter("n > 0")
    hi = F.create_map(*(F.lit(float(x)) for p in pairs for x in p))
    return t.select("lo", F.try_element_at(hi, F.col("lo")).alias("hi"), "n", "valid", "invalid", _score(F.col("valid"), F.col("invalid")).alias("precision"))


def threshold_curve(rows: DataFrame, target: float = 0.88, cutoffs: Sequence[float] = CUTOFFS) -> DataFrame:
    """threshold, kept, valid, invalid, precision, retained, meets: what each confidence cutoff leaves, and the lowest one that reaches ``target``.

    Each label is first counted in its interval between cutoffs; sums from above give the curve, so no row is repeated for a cutoff.
    """
    at = F.array_max(F.filter(F.array(*(F.lit(float(c)) for c in cutoffs)), lambda c: c <= F.col("confidence")))
    per = _tally(rows.withColumn("at", at).filter("at IS NOT NULL"), "at")
    grid = rows.sparkSession.createDataFrame([(float(c),) for c in cutoffs], "threshold double")
    up = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each cutoff
    g = grid.join(per, F.col("threshold") == F.col("at"), "left").select("threshold", *(F.sum(F.coalesce(c, F.lit(0))).over(up).alias(c) for c in ("valid", "invalid")))
    total = rows.agg(F.count_if(F.col("verdict") == "valid").alias("_all"))
    g = g.join(F.broadcast(total)).filter("valid + invalid > 0").withColumn("precision", _score(F.col("valid"), F.col("invalid")))
    low = F.min(F.when(F.col("precision") >= target, F.col("threshold"))).over(Window.partitionBy())
    return g.select("threshold", (F.col("valid") + F.col("invalid")).alias("kept"), "valid", "invalid", "precision", F.coalesce(F.try_divide("valid", "_all"), F.lit(0.0)).alias("retained"), F.coalesce(low == F.col("threshold"), F.lit(False)).alias("meets"))


def top_reasons(rows: DataFrame, most: int = 10) -> DataFrame:
    """reason, n of the commonest reasons for rejection; equals in order of the reason."""
    return rows.filter("verdict = 'invalid'").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def regression_gate(live: DataFrame, rows: DataFrame, core: Sequence[str], duplicates: int = 0, target: float = 0.88, min_samples: int = 20, min_coverage: float = 0.8) -> DataFrame:
    """detector, n, precision, coverage, problems of each detector in ``core``; it passes if no row has a problem.

    Problems: no_sample; few_labels; low_coverage (labels per live finding); low_precision; duplicate_ids.
    """
    lives = live.groupBy(F.col("detector").alias("_d")).agg(F.count("*").alias("_live"))
    t = precision_by_detector(rows, list(core)).filter(F.col("detector").isin(list(core))).join(lives, F.col("detector") == F.col("_d"), "left")
    t = t.withColumn("coverage", F.coalesce(F.try_divide("n", "_live"), F.lit(0.0)))
    some, problem = F.col("n") > 0, lambda c, name: F.when(c, F.lit(name))
    problems = F.array_compact(
        F.array(
            problem(F.lit(duplicates > 0), "duplicate_ids"), problem(~some, "no_sample"), problem(some & (F.col("n") < min_samples), "few_labels"), problem(some & (F.col("coverage") < min_coverage), "low_coverage"),
            problem(some & (F.col("precision") < target), "low_precision"),
        )
    )
    return t.select("detector", "n", "precision", "coverage", problems.alias("problems"))


def recall_candidates(runs: DataFrame, findings: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """Runs that failed without any finding; ``n`` of them drawn by hash."""
    from .sampling import uniform

    silent = runs.filter("NOT resolved").join(findings.select("run_key").distinct(), "run_key", "left_anti")
    return silent if n is None else uniform(silent, ["run_key"], n, seed)


REVIEW = ("finding_id", "verdict", "reason", "reviewer_type", "evidence_steps", "evidence_reference")


def review_problems(packets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """finding_id, problem for every breach of the review rules: each packet judged exactly once, known verdicts, a reason, evidence, an automatic reviewer."""
    v = verdicts.groupBy("finding_id").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in REVIEW[1:] if c in verdicts.columns))
    p = packets.select(F.col("finding_id").alias("_p")).distinct()
    both = p.join(v, F.col("_p") == F.col("finding_id"), "full_outer")
    have = lambda c: c in verdicts.columns
    ok = F.col("finding_id").isNotNull() & F.col("_p").isNotNull()
    tests = {
        "missing": F.col("finding_id").isNull(), "unexpected": F.col("_p").isNull(), "repeated": F.col("_n") > 1, "verdict": ok & ~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "reason": ok & (F.coalesce(F.length(F.btrim("reason")), F.lit(0)) == 0),
        "reviewer": ok & ~F.coalesce(F.col("reviewer_type") == "ai", F.lit(False)) if have("reviewer_type") else F.lit(False), "evidence": ok & (F.coalesce(F.size("evidence_steps"), F.lit(0)) <= 0) & (F.coalesce(F.length("evidence_reference"), F.lit(0)) == 0) if have("evidence_steps") else F.lit(False),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests.items())))
    return both.select(F.coalesce("finding_id", "_p").alias("finding_id"), F.explode(found).alias("problem"))


def adopted_verdicts(expected: DataFrame, fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """Verdicts of ``prior`` for expected findings without a fresh one; ``conflict`` where run, signature or detector differ."""
    open_ = expected.join(fresh.select("finding_id"), "finding_id", "left_anti").select("finding_id", *(F.col(c).alias(f"_{c}") for c in ("run_id", "finding_signature", "detector")))
    differs = F.lit(False)
    for c in ("run_id", "finding_signature", "detector"):
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return open_.join(prior, "finding_id").withColumn("conflict", differs).drop("_run_id", "_finding_signature", "_detector")
