"""Accounting of runs: wasted steps, process shape, contrasts between outcomes, rank statistics.

Per-run figures cost one exchange by ``run_key``; corpus figures are partial aggregates over the narrow report. Ratios are left unrounded; sinks round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelog.functions import predicates as P
from stridelog.functions.text import observation_key, settled

from .ranks import numbered_from_top, sums_below

#: The part of a run that a category belongs to; others count as execution.
PHASES = {"localization_failure": "planning", "submit_despite_failure": "verification", "verification_gap": "verification"}
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}


def outcome(resolved: str = "resolved") -> Column:
    return F.when(F.col(resolved).isNull(), "unknown").when(F.col(resolved), "resolved").otherwise("unresolved")


def phase_of(category: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PHASES.items() for x in kv)), category), F.lit("execution"))


def is_source_edit() -> Column:
    """An edit step that isn't of test or scratch files alone; refused edits, documents and new files count."""
    files = F.coalesce(F.col("files_touched"), F.array().cast("array<string>"))
    own = F.when(F.size(files) > 0, files).when(F.coalesce(F.length("path"), F.lit(0)) > 0, F.array("path")).otherwise(F.array().cast("array<string>"))
    return (F.col("kind") == "edit") & ~((F.size(own) > 0) & F.forall(own, P.is_test_or_scratch))


def _rank(severity: Column | None = None) -> Column:
    ranks = F.create_map(*(F.lit(x) for kv in SEVERITY_RANK.items() for x in kv))
    return F.coalesce(F.try_element_at(ranks, F.col("severity") if severity is None else severity), F.lit(3)).alias("rank")


def attribute_waste(findings: DataFrame) -> DataFrame:
    """run_key, step, category: every wasted step once, for its severest finding; of equals the one reported first. A minimum per step, so no window is sorted."""
    order = F.struct(_rank(), "start", "category", "registry_ord", "emit_ord")
    steps = findings.select("run_key", F.explode_outer("wasted_steps").alias("step"), F.struct(order.alias("o"), F.col("category").alias("c")).alias("x")).filter("step IS NOT NULL")
    return steps.groupBy("run_key", "step").agg(F.min("x").alias("x")).select("run_key", "step", F.col("x.c").alias("category"))


def _counts(df: DataFrame, keys: list[str], what: str, name: str) -> DataFrame:
    """``name``: map from each value of ``what`` to its rows."""
    n = df.groupBy(*keys, what).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(what, "n")))).alias(name))


def process_shape(steps: DataFrame) -> DataFrame:
    """run_key, total_steps, source_edits, test_runs and the ratios made of them: one exchange by run, of a few flags and the result's identity."""
    s = steps.select("run_key", *(c.alias(name) for name, c in _marks_of_step().items())).repartition("run_key")
    k = s.groupBy("run_key", "k").agg(F.count("*").alias("n"), F.count_if("e").alias("e"), F.count_if("t").alias("t"))
    return _ratios(k.groupBy("run_key").agg(F.sum("n").alias("total_steps"), F.sum("e").alias("source_edits"), F.sum("t").alias("test_runs"), F.count("k").alias("_novel"), F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias("_all")))


def _marks_of_step() -> dict[str, Column]:
    """What a run's shape is made of: source edit, test run, and the identity of a result that isn't empty."""
    return {"e": is_source_edit(), "t": F.coalesce("is_test_run", F.lit(False)), "k": F.nullif(observation_key("observation", "error_fp"), F.lit("empty"))}


def _ratios(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "tests_per_source_edit": F.col("test_runs") / F.greatest(F.lit(1), "source_edits"), "test_run_ratio": F.col("test_runs") / F.greatest(F.lit(1), "total_steps"),
        "novel_observation_ratio": F.coalesce(F.try_divide("_novel", "_all"), F.lit(0.0)),
    }).drop("_novel", "_all")


def _tally(values: Column) -> Column:
    """Map from each distinct value of an array to how often it is there."""
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda v: F.struct(v, F.size(F.filter(values, lambda x: x == v)).cast("long"))))


def charged(findings: DataFrame) -> DataFrame:
    """run_key, n_findings, hit, by_severity, by_category, by_phase, wasted_steps of runs with findings: one exchange by run. A run's findings are few, its length bounds their steps.

    Wasted steps are charged once, by the rule of ``attribute_waste``.
    """
    f = findings.select("run_key", _weighed(F.struct("*")).alias("x")).groupBy("run_key").agg(F.array_sort(F.collect_list("x")).alias("_f"))
    return _charges(f)


def _weighed(x: Column) -> Column:
    """A finding in the order in which it is charged."""
    return F.struct(_rank(x["severity"]), *(x[c].alias(c) for c in ("start", "category", "registry_ord", "emit_ord", "severity")), F.coalesce(x["wasted_steps"], F.array().cast("array<int>")).alias("wasted"))


def _charges(f: DataFrame) -> DataFrame:
    """``f`` with the columns of ``charged`` in place of ``_f``, the sorted findings of a run."""
    marks = F.array_sort(F.flatten(F.transform("_f", lambda x, i: F.transform(x["wasted"], lambda s: F.struct(s.alias("step"), i.alias("i"), x["category"].alias("c"))))))
    f = f.withColumn("_marks", settled(marks))
    first = F.filter("_marks", lambda m, i: (i == 0) | (F.get("_marks", i - 1)["step"] != m["step"]))
    f = f.withColumn("_c", settled(F.transform(first, lambda m: m["c"])))
    return f.withColumns({
        "n_findings": F.size("_f").cast("long"), "hit": F.array_sort(F.array_distinct(F.transform("_f", lambda x: x["category"]))), "by_severity": _tally(F.transform("_f", lambda x: x["severity"])),
        "wasted_steps": F.size("_c").cast("long"), "by_category": _tally(F.col("_c")), "by_phase": _tally(F.transform("_c", phase_of)),
    }).drop("_f", "_marks", "_c")


def waste_reports(runs: DataFrame, steps: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a run: waste, findings by category, phase and severity, and process shape. ``hit`` lists the categories with a finding."""
    return _filled(runs.select("run_key", "instance_id", "framework", "resolved").join(process_shape(steps), "run_key", "left").join(charged(findings), "run_key", "left"))


def detected_reports(runs: DataFrame, steps: DataFrame, tier: str | None = None) -> DataFrame:
    """``waste_reports`` of all that the detectors find, without a second pass over the steps: the shape of a run is counted with its facts, and its findings are charged where they are made."""
    from .detectors import findings_of, run_facts

    figures = {"total_steps": F.count("*"), "source_edits": F.count_if("_e"), "test_runs": F.count_if("_t"), "_novel": F.size(F.collect_set("_k")), "_all": F.count("_k")}
    facts = run_facts(steps, runs, {f"_{name}": c for name, c in _marks_of_step().items()}, figures)
    f = facts.select("run_key", "instance_id", "framework", "resolved", *figures, settled(F.array_sort(F.transform(findings_of(tier=tier), _weighed))).alias("_f"))
    return _filled(_charges(_ratios(f)))


def _filled(out: DataFrame) -> DataFrame:
    empty = F.expr("cast(map() as map<string, bigint>)")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total_steps", "wasted_steps", "n_findings", "source_edits", "test_runs")}
    zero |= {c: F.coalesce(c, empty) for c in ("by_category", "by_phase", "by_severity")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("tests_per_source_edit", "test_run_ratio", "novel_observation_ratio")}
    out = out.withColumns(zero).withColumn("hit", F.coalesce("hit", F.array().cast("array<string>")))
    return out.withColumn("wasted_step_ratio", F.coalesce(F.try_divide("wasted_steps", "total_steps"), F.lit(0.0)))


MEANS = {
    "mean_steps": "total_steps", "mean_wasted_steps": "wasted_steps", "mean_wasted_step_ratio": "wasted_step_ratio", "mean_source_edits": "source_edits", "mean_test_runs": "test_runs",
    "mean_tests_per_source_edit": "tests_per_source_edit", "mean_test_run_ratio": "test_run_ratio", "mean_novel_observation_ratio": "novel_observation_ratio",
}


def outcome_stats(reports: DataFrame) -> DataFrame:
    """label, n and means of all runs and of each outcome that occurs: one rollup."""
    r = reports.withColumn("outcome", outcome())
    out = r.rollup("outcome").agg(F.count("*").alias("n"), *(F.avg(c).alias(m) for m, c in MEANS.items()), F.grouping("outcome").alias("_all"))
    return out.filter("n > 0").select(F.when(F.col("_all") == 1, "all").otherwise(F.col("outcome")).alias("label"), "n", *MEANS)


def category_stats(reports: DataFrame) -> DataFrame:
    """label, category, category_rate (share of runs with a finding), mean_waste (attributed steps a run), for all runs and each outcome."""
    # besides its categories each run counts once without one: so the reports are read once, and what follows is a few rows
    r = reports.select(F.explode(F.array(F.lit("all"), outcome())).alias("label"), F.concat(F.array(F.lit(None).cast("string")), "hit").alias("hit"), "by_category")
    each = r.select("label", F.explode("hit").alias("category"), "by_category").groupBy("label", "category").agg(F.count("*").alias("_hits"), F.sum(F.coalesce(F.try_element_at("by_category", F.col("category")), F.lit(0))).alias("_waste"))
    each = each.withColumn("_n", F.max(F.when(F.col("category").isNull(), F.col("_hits"))).over(Window.partitionBy("label")))
    return each.filter("category IS NOT NULL").select("label", "category", (F.col("_hits") / F.col("_n")).alias("category_rate"), (F.col("_waste") / F.col("_n")).alias("mean_waste"))


def category_lift(reports: DataFrame, positive: str = "unresolved", negative: str = "resolved") -> DataFrame:
    """category, lift: rate among ``positive`` runs less that among ``negative`` ones; no rows if either group is missing. verdict: separates, weak or no contrast."""
    r = reports.withColumn("o", outcome())
    n = r.agg(F.count_if(F.col("o") == positive).alias("_p"), F.count_if(F.col("o") == negative).alias("_n"))
    hits = r.select("o", F.explode("hit").alias("category")).filter(F.col("o").isin(positive, negative)).groupBy("category").agg(F.count_if(F.col("o") == positive).alias("p"), F.count_if(F.col("o") == negative).alias("q"))
    out = hits.join(F.broadcast(n)).filter("_p > 0 AND _n > 0").select("category", (F.col("p") / F.col("_p") - F.col("q") / F.col("_n")).alias("lift"))
    return out.withColumn("verdict", F.when(F.col("lift") >= 0.10, "separates").when(F.col("lift") >= 0.03, "weak").otherwise("no contrast"))


def kind_mix(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Steps of each kind and their share, within ``by``."""
    keys = by or []
    n = steps.groupBy(*keys, "kind").agg(F.count("*").alias("n"))
    whole = n.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.sum("n").alias("_all"))
    joined = n.join(whole, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]) if keys else n.join(F.broadcast(whole))
    return joined.select(*keys, "kind", "n", (F.col("n") / F.col("_all")).alias("share"))


PREDICTORS = ("total_steps", "wasted_steps", "wasted_step_ratio", "n_findings", "source_edits", "test_runs", "tests_per_source_edit", "test_run_ratio", "novel_observation_ratio")


def auc(scores: DataFrame, group: str, score: str, positive: str, occurs: str | None = None) -> DataFrame:
    """group, auc: chance that a positive row outranks a negative one, ties counting half; NaN without both classes. ``occurs``: a mark that some row of a group must have for the group to be shown.

    Rows are first counted by score, and the running sums are made range by range.
    """
    seen = F.bool_or(occurs) if occurs else F.lit(True)
    c = scores.groupBy(group, score).agg(seen.alias("_seen"), F.count_if(positive).cast("double").alias("p"), F.count_if(~F.col(positive)).cast("double").alias("q")).persist()  # read for the cuts, the ranges and the rows
    wins = sums_below(c, group, score, "q").withColumn("w", F.col("p") * (F.col("below") + F.col("q") / 2)).groupBy(group).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"), F.bool_or("_seen").alias("_seen"))
    return wins.filter("_seen").select(group, F.when((F.col("p") > 0) & (F.col("q") > 0), F.try_divide("w", F.col("p") * F.col("q"))).otherwise(F.lit(float("nan"))).alias("auc"))


def discrimination(reports: DataFrame) -> DataFrame:
    """predictor, auc of failing, over runs with a known outcome: process figures, and wasted steps of each registered category that occurs."""
    from .detectors import REGISTRY

    r = reports.filter("resolved IS NOT NULL").withColumn("failed", ~F.col("resolved"))
    one = lambda name, score, seen: F.struct(F.lit(name).alias("predictor"), score.cast("double").alias("score"), seen.alias("seen"))
    figures = [one(p, F.col(p), F.lit(True)) for p in PREDICTORS]
    steps = [one(f"wasted_steps:{c}", F.coalesce(F.try_element_at("by_category", F.lit(c)), F.lit(0)), F.map_contains_key("by_category", c)) for c in sorted(REGISTRY)]
    long = r.select("failed", F.explode(F.array(*figures, *steps)).alias("x")).select("failed", "x.*")
    return auc(long, "predictor", "score", "failed", occurs="seen")


def top_failures(reports: DataFrame, shares: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 1.00)) -> DataFrame:
    """share, k, failed_rate among the runs with the highest waste ratio, equal ratios in the order of their run_key's SHA-256."""
    known = reports.filter("resolved IS NOT NULL").select("run_key", "wasted_step_ratio", (~F.col("resolved")).cast("int").alias("f"))
    known = known.repartition(F.xxhash64("run_key")).persist()  # read for the cuts, the ranges and the rows, at once: behind an exchange the reports are made for all of them together
    r, n = numbered_from_top(known, "wasted_step_ratio", "run_key"), known.agg(F.count("*").alias("_all"))
    cut = r.join(F.broadcast(n)).withColumn("share", F.explode(F.array(*(F.lit(float(q)) for q in shares)))).filter(F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("_all") * F.col("share"))))
    return cut.groupBy("share").agg(F.count("*").alias("k"), F.avg("f").alias("failed_rate"))


def detector_profile(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """detector, pattern, rates of runs hit by outcome, lift, findings, wasted steps per unresolved run."""
    n = runs.agg(F.count_if("resolved").alias("_r"), F.count_if(~F.col("resolved")).alias("_u"))
    per = findings.groupBy("detector", "pattern", "run_key").agg(F.first("resolved").alias("resolved"), F.count("*").alias("n"), F.sum(F.size("wasted_steps")).alias("w"))
    out = per.groupBy("detector", "pattern").agg(F.count_if("resolved").alias("r"), F.count_if(~F.col("resolved")).alias("u"), F.sum("n").alias("findings"), F.coalesce(F.sum(F.when(~F.col("resolved"), F.col("w"))), F.lit(0)).alias("w"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.join(F.broadcast(n)).select("detector", "pattern", rate("r", "_r").alias("resolved_rate"), rate("u", "_u").alias("unresolved_rate"), "findings", rate("w", "_u").alias("waste_per_unresolved"))
    return out.withColumn("lift", F.col("unresolved_rate") - F.col("resolved_rate"))


def cross_framework(reports: DataFrame, steps: DataFrame) -> DataFrame:
    """One row a framework: pooled ratios of the sums, not means of ratios."""
    other = steps.filter("kind = 'other'").groupBy("run_key").agg(F.count("*").alias("other"))
    r = reports.join(other, "run_key", "left").groupBy("framework").agg(
        F.count("*").alias("runs"), F.sum("total_steps").alias("steps"), F.coalesce(F.sum("other"), F.lit(0)).alias("unmapped"), F.sum("source_edits").alias("_e"), F.sum("test_runs").alias("_t"), F.sum("wasted_steps").alias("_w"), F.sum("n_findings").alias("_f")
    )
    per = lambda a, b: F.col(a) / F.greatest(F.lit(1), b)
    return r.select("framework", "runs", "steps", per("steps", "runs").alias("mean_steps"), "unmapped", per("_e", "runs").alias("mean_source_edits"), per("_t", "runs").alias("mean_test_runs"), per("_t", "_e").alias("tests_per_edit"), per("_w", "steps").alias("wasted_step_ratio"), per("_f", "runs").alias("findings_per_run"))


def repo_of() -> Column:
    """The repository, or the instance's name without what follows its last hyphen."""
    return F.coalesce(F.nullif("repo", F.lit("")), F.regexp_replace("instance_id", "-[^-]*$", ""))


def failed_step() -> Column:
    return F.col("error_fp").isNotNull() | F.col("error_kind").isNotNull() | (F.coalesce("exit_code", F.lit(0)) != 0)


def pool_totals(runs: DataFrame, steps: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of corpus totals."""
    blank = F.coalesce(F.col("observation").rlike(r"(?U)\A\s*\z"), F.lit(True))
    s = steps.agg(
        F.count("*").alias("steps"), F.count_if(failed_step()).alias("failed_steps"), F.count_if(F.coalesce("exit_code", F.lit(0)) != 0).alias("nonzero_exits"), F.count_if(F.length("error_kind") > 0).alias("error_kinds"),
        F.count_if(F.col("kind").isin("shell", "edit") & blank).alias("empty_observations"),
    )
    r = runs.agg(F.count("*").alias("records"), F.count_distinct(repo_of()).alias("distinct_repos"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"), F.count_if(F.col("resolved").isNull()).alias("unknown"))
    f = findings.agg(F.count("*").alias("findings"))
    w = attribute_waste(findings).agg(F.count("*").alias("wasted_steps"))
    return r.join(F.broadcast(s)).join(F.broadcast(f)).join(F.broadcast(w))  # one row each


def findings_by_detector(findings: DataFrame) -> DataFrame:
    """run_key, by_detector: findings of each detector in a run."""
    return _counts(findings, ["run_key"], "detector", "by_detector")


def unmapped_runs(steps: DataFrame) -> DataFrame:
    """Runs with steps of no known tool, and how many."""
    return steps.filter("kind = 'other'").groupBy("run_key").agg(F.count("*").alias("n"))
