"""Console forms of results, and the command line: ``python -m stridelog``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelog.operators import detectors, metrics
from stridelog.operators.identity import distinct_findings, run_ids, with_identity
from stridelog.operators.sampling import capped, head_and_tail, review_rows
from stridelog.sources.adapters import ADAPTERS, load, loaded, parsed
from stridelog.sources.gold import gold_coverage, load_gold
from stridelog.sources.records import numbered, read_records


def table(rows: list, columns: list[str]) -> str:
    """Aligned text; floats to four places, nothing as a dash."""
    shown = [[c for c in columns]] + [[("—" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in (r[c] for c in columns)] for r in rows]
    widths = [max(len(r[k]) for r in shown) for k in range(len(columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in shown]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:]])


def bar(share: float | None, width: int = 20) -> str:
    if share is None or share != share:
        return " " * width
    n = round(share * width)
    return "█" * n + "·" * (width - n)


def precision_markdown(rows: list) -> str:
    """Precision by detector, highest first and then by name; rules without labels come last with a dash."""
    order = sorted(rows, key=lambda r: (r["precision"] != r["precision"], -(r["precision"] if r["precision"] == r["precision"] else 0), r["detector"]))
    cell = lambda p: "—" if p != p else f"{100 * p:.1f}%"
    return "\n".join(["| detector | n | valid | invalid | precision |", "|---|---|---|---|---|", *(f"| `{r['detector']}` | {r['n']} | {r['valid']} | {r['invalid']} | {cell(r['precision'])} |" for r in order)])


def finding_line(f) -> str:
    return f"[{f['severity']:6}] {f['category']:22} steps {f['start']}-{f['end']} ({len(f['wasted_steps'])} wasted) :: {f['evidence']}"


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("run_key", "start", "category", "registry_ord", "emit_ord")


def replay(spark: SparkSession, path: str, index: int | None = None, instance: str | None = None, tier: str | None = "core", framework: str | None = None, gold: str | None = None, max_rows: int = 60, min_confidence: float = 0.0) -> str:
    """One run in words. The record is chosen before it is parsed: by its place, or the first of an instance."""
    records = numbered(read_records(spark, path))
    if instance is not None:
        named = F.coalesce(F.get_json_object("record", "$.instance_id"), F.get_json_object("record", "$.info.instance_id"), F.get_json_object("record", "$.environment"), F.get_json_object("record", "$.trajectory_id"))
        records = records.filter(named == instance).orderBy("file", "pos").limit(1)
    else:
        records = records.orderBy("file", "pos").offset(index or 0).limit(1)
    runs, steps = loaded(parsed(records.drop("pos"), framework), load_gold(spark, gold) if gold else None)
    found = runs.collect()
    if not found:
        raise LookupError("no such run")
    run = found[0]
    findings = detectors.filter_findings(detectors.detect_all(steps, runs, tier=tier), min_confidence)
    fs = ordered(findings).collect()
    wasted = {i: f["category"] for f in sorted(fs, key=lambda f: metrics.SEVERITY_RANK.get(f["severity"], 3), reverse=True) for i in f["wasted_steps"]}
    from stridelog.functions.text import action_summary

    shown = head_and_tail(steps.select("run_key", "idx", "kind", action_summary(72).alias("action"), "error_kind", "is_test_run"), ["run_key"], "idx", max_rows).orderBy("idx").collect()
    n = steps.count()
    head = f"{run.instance_id}  [{run.framework}]  resolved={run.resolved}  steps={n}  wasted={len(wasted)} ({len(wasted) / max(1, n):.1%})  exit={run.exit_status}"
    rows = [{"step": s.idx, "kind": s.kind, "action": s.action, "error": s.error_kind, "waste": wasted.get(s.idx)} for s in shown]
    return "\n\n".join([head, table(rows, ["step", "kind", "action", "error", "waste"]), "\n".join(map(finding_line, fs)) or "no findings"])


def diagnose(spark: SparkSession, path: str, gold: str | None = None, outcome: str = "all", tier: str | None = None, framework: str | None = None, limit: int | None = None, min_confidence: float = 0.0) -> tuple[str, dict]:
    """(text, report) of a corpus; outcome: all, resolved or unresolved."""
    from stridelog.sources.sinks import corpus_report

    runs, steps = load(spark, path, framework, gold, limit=limit)
    said = []
    if gold:
        c = gold_coverage(runs).first()
        said.append(f"gold attached to {c.attached} of {c.trajectories} runs ({c.ratio:.1%})")
    if outcome != "all":
        runs = runs.filter(F.col("resolved") == (outcome == "resolved"))
        steps = steps.join(runs.select("run_key"), "run_key", "left_semi")
    runs, steps = runs.persist(), steps.persist()
    try:
        reports = metrics.waste_reports(runs, steps, detectors.filter_findings(detectors.detect_all(steps, runs, tier=tier), min_confidence)).persist()
        report = corpus_report(reports, {"tier": tier or "all", "outcome": outcome, "min_confidence": min_confidence})
        reports.unpersist()
    finally:
        runs.unpersist()
        steps.unpersist()
    if not report["n_trajectories"]:
        return "nothing to analyse", report
    groups = [report["overall"], *report["by_outcome"].values()]
    said.append(table(groups, ["label", "n", *metrics.MEANS]))
    lift = report["category_lift_unresolved_minus_resolved"]
    said.append(table([{"category": k, "lift": float(v)} for k, v in sorted(lift.items(), key=lambda x: -x[1])], ["category", "lift"]))
    return "\n\n".join(said), report


def sample_findings(spark: SparkSession, path: str, per_detector: int = 40, seed: int = 0, around: int = 3, tier: str | None = "core", framework: str | None = None, gold: str | None = None, limit: int | None = None, obs_chars: int = 400) -> DataFrame:
    """Findings drawn for review, each claim once, with the steps around them."""
    runs, steps = load(spark, path, framework, gold, limit=limit)
    found, _ = distinct_findings(with_identity(detectors.detect_all(steps, runs, tier=tier), run_ids(runs, steps)))
    return review_rows(capped(found, ["detector"], ["finding_id"], per_detector, seed), steps, around, obs_chars)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="stridelog", description="Rule-based diagnosis of agent run logs")
    sub = top.add_subparsers(dest="do", required=True)
    for name in ("replay", "diagnose", "export", "findings"):
        p = sub.add_parser(name)
        p.add_argument("data")
        p.add_argument("--framework")
        p.add_argument("--gold")
        p.add_argument("--limit", type=int)
        p.add_argument("--tier", default="core" if name in ("replay", "findings") else "all", choices=["core", "experimental", "all"])
        p.add_argument("--min-confidence", type=float, default=0.0)
        p.add_argument("--out")
        if name == "replay":
            p.add_argument("--index", type=int)
            p.add_argument("--instance")
            p.add_argument("--max-rows", type=int, default=60)
        if name == "diagnose":
            p.add_argument("--outcome", default="all", choices=["all", "resolved", "unresolved"])
        if name == "export":
            p.add_argument("--format", default="jsonl", choices=["jsonl", "json", "csv"])
        if name == "findings":
            p.add_argument("--per-detector", type=int, default=40)
            p.add_argument("--seed", type=int, default=0)
            p.add_argument("--context", type=int, default=3)
    sub.add_parser("detectors")
    sub.add_parser("adapters")
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("stridelog").getOrCreate()
    tier = None if getattr(a, "tier", "all") == "all" else a.tier
    try:
        if a.do == "detectors":
            print(table([dict(zip(("name", "tier", "finds"), d, strict=True)) for d in detectors.describe()], ["name", "tier", "finds"]))
        elif a.do == "adapters":
            print(table([{"name": n, "framework": x.framework} for n, x in ADAPTERS.items()], ["name", "framework"]))
        elif a.do == "replay":
            print(replay(spark, a.data, a.index, a.instance, tier, a.framework, a.gold, a.max_rows, a.min_confidence))
        elif a.do == "diagnose":
            import json

            text, report = diagnose(spark, a.data, a.gold, a.outcome, tier, a.framework, a.limit, a.min_confidence)
            print(text)
            if a.out:
                with open(a.out, "w", encoding="utf-8") as f:
                    json.dump(report, f, indent=2, ensure_ascii=False)
            return 0 if report["n_trajectories"] else 1
        elif a.do == "export":
            from stridelog.sources.sinks import export_rows, write_csv, write_json, write_jsonl

            runs, steps = load(spark, a.data, a.framework, a.gold, limit=a.limit)
            found = detectors.filter_findings(detectors.detect_all(steps, runs, tier=tier), a.min_confidence)
            reports = metrics.waste_reports(runs, steps, found)
            if a.format == "csv":
                write_csv(reports, a.out)
            else:
                (write_json if a.format == "json" else write_jsonl)(export_rows(reports, found), a.out)
        else:
            from stridelog.sources.sinks import write_jsonl

            write_jsonl(sample_findings(spark, a.data, a.per_detector, a.seed, a.context, tier, a.framework, a.gold, a.limit), a.out)
    except (ValueError, LookupError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0
