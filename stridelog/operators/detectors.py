"""Rules over runs that give evidence-carrying interval findings.

``run_facts`` condenses each run to one row with a single exchange by ``run_key``; every rule is then an expression over that row, so all rules
together cost no further shuffle. Rules live in a registry in the order in which their findings are reported.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from inspect import signature
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelog.functions import predicates as P
from stridelog.functions.diff import patch_files
from stridelog.functions.text import repo_relative, settled

from .sequence import by_run, dense_groups, edit_sessions, with_flags

SEVERITIES = ("low", "medium", "high")


class Rule(NamedTuple):
    pattern: str
    phase: str
    severity: str
    confidence: float
    fires: Column  # over run facts
    start: Column
    end: Column
    wasted: Column
    evidence: Column
    detail: Column  # struct


class EachRule(NamedTuple):
    """A rule that gives one finding for each element of an array over run facts."""

    each: Column
    rule: Callable[[Column], Rule]


class Detector(NamedTuple):
    name: str
    tier: str
    rules: Callable[..., list[Rule | EachRule]]
    doc: str


REGISTRY: dict[str, Detector] = {}


def register(name: str, tier: str = "experimental"):
    """Adds a detector: a function of keyword options that returns rules."""

    def add(rules: Callable[..., list[Rule]]) -> Callable[..., list[Rule]]:
        REGISTRY[name] = Detector(name, tier, rules, (rules.__doc__ or "").strip().splitlines()[0])
        return rules

    return add


def run_facts(steps: DataFrame, runs: DataFrame, more: dict[str, Column] | None = None, figures: dict[str, Column] | None = None) -> DataFrame:
    """One row a run: ``runs`` with what its steps say. Runs without steps keep nulls; steps without a run are dropped.

    ``figures``: further aggregates of a run's steps, over ``more`` columns of them, so that whoever needs both reads the steps once.
    """
    f = edit_sessions(with_flags(steps, more)).withColumn("last_submit", F.max(F.when(F.col("kind") == "submit", F.col("idx"))).over(by_run()))
    edit, i = F.col("kind") == "edit", F.col("idx")
    ordered = lambda keep, what=i: F.array_sort(F.collect_list(F.when(keep, what)))
    checked = F.col("verifies") & (i < F.col("last_submit"))
    streak = (edit & (F.col("rejected") | F.startswith(F.coalesce("error_fp", F.lit("")), F.lit("edit_rejected")))) & (F.size("files") > 0)
    source = F.filter("paths", lambda p: ~F.array_contains(F.col("created_files"), p) & ~P.is_test_or_scratch(p) & ~P.is_doc_or_config(p))
    f = f.withColumn("_streak", streak).withColumn("_source", F.when(F.col("landed"), source))
    facts = f.groupBy(F.col("run_key").alias("_r")).agg(
        F.count("*").cast("int").alias("n_steps"),
        F.first("last_submit").alias("submitted_at"),
        ordered(edit).alias("edit_steps"),
        ordered(F.col("session")).alias("sessions"),
        F.max(F.when(F.col("edit_event"), i)).alias("last_event"),
        F.max(F.when(F.col("verifies"), i)).alias("last_verify"),
        F.max_by(F.struct(i.alias("idx"), "error_kind", "exit_code"), F.when(checked, i)).alias("checked"),
        F.first("created_files").alias("made_files"),
        F.first("created_scripts").alias("made_scripts"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("landed") & (F.coalesce("verb", F.lit("")) != "create"), F.col("paths"))))).alias("modified"),
        F.array_distinct(F.flatten(F.collect_list(F.when(edit, F.col("paths"))))).alias("edited"),
        ordered(F.col("_streak"), F.struct(i.alias("idx"), repo_relative(F.col("files")[0]).alias("path"))).alias("refused"),
        ordered(F.col("landed"), F.struct(i.alias("idx"), F.col("paths").alias("paths"))).alias("landings"),
        ordered(F.col("landed") & (F.size("_source") > 0), F.struct(i.alias("idx"), F.col("_source").alias("paths"))).alias("source_landed"),
        F.max(F.when(F.col("reverts"), i)).alias("last_revert"),
        *(c.alias(name) for name, c in (figures or {}).items()),
    )
    return runs.join(facts, F.col("run_key") == F.col("_r"), "left").drop("_r").withColumn("n_steps", F.coalesce("n_steps", F.lit(0))).withColumn("patched", settled(patch_files(F.col("model_patch"))))


def _none() -> Column:
    return F.array().cast("array<int>")


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def py_list(c: Column, open_: str = "[", close: str = "]") -> Column:
    """An array of strings as Python shows it; a tuple of one keeps its comma."""
    quote = lambda s: F.when(F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"')), F.concat(F.lit('"'), s, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
    one = F.when(F.size(c) == 1, F.lit("," + close)).otherwise(F.lit(close)) if open_ == "(" else F.lit(close)
    return F.concat(F.lit(open_), F.array_join(F.transform(c, quote), ", "), one)


@register("verification_gap")
def verification_gap(stale_grace: int = 3) -> list[Rule]:
    """Source was edited and never checked, or not after its last edit. ``stale_grace`` is accepted and has no effect."""
    end = F.coalesce(F.col("submitted_at"), F.col("n_steps") - 1)
    checked, n = F.col("last_verify").isNotNull(), F.size("sessions")
    return [
        Rule("never_verified", "verification", "high", 0.9, ~checked & (n > 0), F.col("sessions")[0], end, _none(), _text("submitted after ", n, " edit session(s) without ever executing the test suite or a self-written script"), F.struct(F.lit("never_verified").alias("pattern"), n.alias("n_edits"))),
        Rule(
            "stale_verification", "verification", "medium", 0.8, checked & (F.col("last_event") > F.col("last_verify")) & (F.col("last_verify") < end), F.col("last_verify"), end, _none(),
            _text("last verification ran at step ", F.col("last_verify"), " but the final edit was step ", F.col("last_event"), "; ", end - F.col("last_verify"), " later steps went unverified"),
            F.struct(F.lit("stale_verification").alias("pattern"), F.col("last_verify").alias("last_test"), F.col("last_event").alias("last_edit")),
        ),
    ]


@register("submit_despite_failure")
def submit_despite_failure() -> list[Rule]:
    """The last check before the submission failed, and the run submitted."""
    c = F.col("checked")
    failed = (F.coalesce(c["error_kind"], F.lit("")) != "") | (F.coalesce(c["exit_code"], F.lit(0)) != 0)
    evidence = _text(
        "last verification before submit (step ", c["idx"], ") failed", F.when(F.coalesce(c["error_kind"], F.lit("")) != "", F.concat(F.lit(": "), c["error_kind"])),
        F.when(F.coalesce(c["exit_code"], F.lit(0)) != 0, _text(" (exit ", c["exit_code"], ")")), "; submitted at step ", F.col("submitted_at"), " with no later passing check",
    )
    name = "submitted_after_failed_verification"
    detail = F.struct(F.lit(name).alias("pattern"), c["idx"].alias("last_verification"), F.col("submitted_at").alias("submit_step"), c["error_kind"].alias("error_kind"), c["exit_code"].alias("exit_code"))
    return [Rule(name, "verification", "high", 0.8, F.col("submitted_at").isNotNull() & (F.size("sessions") > 0) & c["idx"].isNotNull() & failed, c["idx"], F.col("submitted_at"), _none(), evidence, detail)]


@register("edit_error")
def edit_error(min_repeats: int = 3, window: int = 10) -> list[Rule]:
    """Refused edits of one file close together with no landed edit among them."""
    paths = F.array_distinct(F.transform("refused", lambda r: r["path"]))
    spans = F.flatten(
        F.transform(
            paths,
            lambda p: F.transform(dense_groups(F.transform(F.filter("refused", lambda r: r["path"] == p), lambda r: r["idx"]), min_repeats, window), lambda s: F.struct(p.alias("path"), s.alias("span"))),
        )
    )
    span_of = lambda e: (F.array_min(e["span"]), F.array_max(e["span"]))
    healed = lambda e: F.exists("landings", lambda d: d["idx"].between(*span_of(e)) & F.array_contains(d["paths"], e["path"]))

    def streak(x: Column) -> Rule:
        lo, hi = span_of(x)
        return Rule(
            "rejected_edit_streak", "execution", "medium", 0.8, F.lit(True), lo, hi, F.slice(x["span"], F.lit(2), F.size(x["span"])), _text(F.size(x["span"]), " rejected edits against ", x["path"], " within ", hi - lo, " steps"),
            F.struct(F.lit("rejected_edit_streak").alias("pattern"), x["path"].alias("path"), x["span"].alias("occurrences")),
        )

    return [EachRule(F.coalesce(F.filter(spans, lambda e: ~healed(e)), F.expr("cast(array() as array<struct<path:string,span:array<int>>>)")), streak)]


def _edits(first: Column) -> tuple[Column, Column]:
    e = F.col("edit_steps")
    return F.when(F.size(e) > 0, first).otherwise(F.lit(0)), F.when(F.size(e) > 0, F.try_element_at(e, F.lit(-1))).otherwise(F.col("n_steps") - 1)


@register("localization_failure")
def localization_failure() -> list[Rule]:
    """No file of the patch is one that the reference solution touches. Needs gold files."""
    known = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(c, repo_relative), lambda p: p != "")))
    gold, patched = known("gold_files"), known("patched")
    said = F.when(F.size(patched) > 0, patched).otherwise(F.array_sort("edited"))
    start, end = _edits(F.get("edit_steps", F.lit(0)))
    evidence = _text("agent edited ", F.when(F.size(said) > 0, py_list(said)).otherwise(F.lit("nothing")), " but the gold patch touches ", py_list(gold))
    fires = (F.size("gold_files") > 0) & ~F.coalesce(F.arrays_overlap(patched, gold), F.lit(False))
    detail = F.struct(F.lit("gold_miss").alias("pattern"), gold.alias("gold_files"), patched.alias("patched_files"))
    return [Rule("gold_miss", "planning", "high", 0.95, fires, start, end, F.coalesce("edit_steps", _none()), evidence, detail)]


@register("lost_edit")
def lost_edit() -> list[Rule]:
    """Landed edits of source that was there before are missing from the final patch."""
    absent = F.filter(F.transform("source_landed", lambda d: F.struct(d["idx"].alias("idx"), F.filter(d["paths"], lambda p: ~P.in_patch(p, F.col("patched"))).alias("paths"))), lambda d: F.size(d["paths"]) > 0)
    steps, files = F.transform(absent, lambda d: d["idx"]), F.array_sort(F.array_distinct(F.flatten(F.transform(absent, lambda d: d["paths"]))))
    first = F.transform(F.slice(files, 1, 3), lambda p: F.concat(p, F.lit(" edited at step "), F.array_min(F.transform(F.filter(absent, lambda d: F.array_contains(d["paths"], p)), lambda d: d["idx"])).cast("string")))
    evidence = _text(F.size(files), " edited file(s) absent from the final patch (later discarded?): ", F.array_join(first, "; "))
    late = F.coalesce(F.col("last_revert") >= F.array_max(steps), F.lit(False))
    detail = F.struct(F.lit("edit_missing_from_patch").alias("pattern"), files.alias("lost_files"), steps.alias("edit_steps"), late.alias("had_revert_after_edit"))
    fires = (F.coalesce(F.length(F.regexp_replace("model_patch", r"\s", "")), F.lit(0)) > 0) & (F.size(steps) > 0)
    return [Rule("edit_missing_from_patch", "execution", "medium", 0.75, fires, F.array_min(steps), F.array_max(steps), steps, evidence, detail)]


@register("termination_anomaly", "core")
def termination_anomaly() -> list[Rule]:
    """The run ended wrongly: empty patch, step budget, a patch without source, or no submission."""
    n, status = F.col("n_steps"), F.lower(F.coalesce("exit_status", F.lit("")))
    capped = F.contains(status, F.lit("maximum iteration")) | F.contains(status, F.lit("max iteration"))
    end = F.greatest(F.lit(0), n - 1)
    path = repo_relative
    outside = lambda f: P.is_test_tree_file(path(f)) | F.coalesce(F.array_contains("made_scripts", path(f)), F.lit(False)) | (~F.coalesce(F.array_contains("modified", path(f)), F.lit(False)) & P.is_scratch_named(path(f)))
    start, last = _edits(F.get("edit_steps", F.lit(0)))
    only = lambda p: F.struct(F.lit(p).alias("pattern"))
    submitted = F.col("submitted_at").isNotNull() | F.contains(status, F.lit("submitted"))
    return [
        Rule("empty_patch", "execution", "high", 0.98, F.col("model_patch").isNotNull() & F.col("model_patch").rlike(r"(?U)\A\s*\z") & (n > 0), F.lit(0), end, F.sequence(F.lit(0), end), _text("run finished with an empty patch after ", n, " steps"), only("empty_patch")),
        Rule("iteration_cap", "execution", "high", 0.95, capped, end, end, _none(), _text("run was killed by the step budget: ", F.col("exit_status")), F.struct(F.lit("iteration_cap").alias("pattern"), F.col("exit_status").alias("exit_status"))),
        Rule(
            "patch_ignores_source", "execution", "high", 0.9, (F.size("patched") > 0) & F.forall("patched", outside), start, last, F.when(F.size("edit_steps") > 1, F.slice("edit_steps", F.lit(2), F.size("edit_steps"))).otherwise(_none()),
            _text("patch touches only test/scratch files and no library source: ", py_list(F.col("patched"), "(", ")")), F.struct(F.lit("patch_ignores_source").alias("pattern"), F.col("patched").alias("patched_files")),
        ),
        Rule("no_submit", "execution", "medium", 0.85, (n > 0) & ~capped & ~submitted, n - 1, n - 1, _none(), F.lit("trajectory contains no submit/finish action"), only("no_submit")),
    ]


#: Reporting order of equal (start, category).
ORDER = ("verification_gap", "submit_despite_failure", "edit_error", "localization_failure", "lost_edit", "termination_anomaly")


def findings_of(only: Sequence[str] | None = None, tier: str | None = None, **options) -> Column:
    """The findings of the chosen detectors as an array over run facts. Others are left out before a plan is made.

    A detector that doesn't take all of ``options`` runs with its defaults; an option that no registered detector takes is an error.
    """
    unknown = set(only or ()) - set(REGISTRY)
    if unknown:
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    takes = {n: set(signature(d.rules).parameters) for n, d in REGISTRY.items()}
    if unknown := set(options) - set().union(*takes.values()):
        raise ValueError(f"options of no detector: {sorted(unknown)}")
    chosen = [REGISTRY[n] for n in sorted(REGISTRY, key=lambda n: (ORDER.index(n) if n in ORDER else len(ORDER), n)) if (only is None or n in only) and (tier is None or REGISTRY[n].tier == tier)]
    if not chosen:
        raise ValueError("no detector is chosen")

    def made(r: Rule, d: Detector, order: int, emit: int) -> Column:
        return F.struct(
            F.lit(d.name).alias("detector"), F.lit(r.pattern).alias("pattern"), F.lit(d.name).alias("category"), F.lit(r.phase).alias("phase"), F.lit(r.severity).alias("severity"), r.start.cast("int").alias("start"), r.end.cast("int").alias("end"),
            r.wasted.cast("array<int>").alias("wasted_steps"), r.evidence.alias("evidence"), F.lit(r.confidence).alias("confidence"), F.to_json(r.detail, {"ignoreNullFields": "false"}).alias("detail"), F.lit(order).alias("registry_ord"), F.lit(emit).alias("emit_ord"),
        )

    def of_element(r: EachRule, *at) -> Callable[[Column], Column]:
        return lambda x: made(r.rule(x), *at)

    one, many = [], []
    for order, d in enumerate(chosen):
        for emit, r in enumerate(d.rules(**options) if takes[d.name] >= set(options) else d.rules()):
            if isinstance(r, EachRule):
                many.append(F.transform(r.each, of_element(r, d, order, emit)))
            else:
                one.append(F.when(F.coalesce(r.fires, F.lit(False)), made(r, d, order, emit)))
    # all findings of a run are one array, so the facts are read once
    lists = [*([F.array_compact(F.array(*one))] if one else []), *many]
    return settled(F.concat(*lists) if len(lists) > 1 else lists[0])


def detect_on(facts: DataFrame, only: Sequence[str] | None = None, tier: str | None = None, **options) -> DataFrame:
    """Findings of the chosen detectors over run facts, one a row."""
    keys = ["run_key", "instance_id", "framework", "resolved"]
    return facts.select(*keys, F.explode_outer(findings_of(only, tier, **options)).alias("f")).filter("f IS NOT NULL").select(*keys, "f.*")


def detect_all(steps: DataFrame, runs: DataFrame, only: Sequence[str] | None = None, tier: str | None = None, **options) -> DataFrame:
    """Findings of ``steps`` and ``runs``. Sort by run_key, start, category, registry_ord, emit_ord for the reporting order."""
    return detect_on(run_facts(steps, runs), only, tier, **options)


def filter_findings(findings: DataFrame, min_confidence: float = 0.0, categories: Sequence[str] | None = None, min_severity: str | None = None) -> DataFrame:
    out = findings.filter(F.col("confidence") >= min_confidence)
    if categories is not None:
        out = out.filter(F.col("category").isin(list(categories)))
    if min_severity is not None:
        out = out.filter(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(min_severity) :]))
    return out


def describe() -> list[tuple[str, str, str]]:
    """(name, tier, what it finds), sorted."""
    return sorted((d.name, d.tier, d.doc) for d in REGISTRY.values())
