"""Versioned identities of runs and findings: digests of canonical JSON.

Canonical JSON (sorted keys, no blanks, non-ASCII kept) is what Python's ``json`` writes, so the digests are made in an Arrow UDF from the native JSON
text. Whole numbers written as 1.0 in a log come out as 1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 2


def canonical(value) -> str:
    import json

    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def digest_of(value) -> str:
    import hashlib

    return hashlib.sha256(canonical(value).encode("utf-8", "surrogatepass")).hexdigest()


@F.pandas_udf(T.StringType())
def digest(text: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of JSON texts; null stays null."""
    import json

    return text.map(lambda t: digest_of(json.loads(t)) if isinstance(t, str) else None)


@F.pandas_udf(T.StringType())
def _run_digest(text: pd.Series) -> pd.Series:
    """Digest of a run; args, state and meta are JSON texts inside its JSON, and an unknown tool's action shows its arguments as Python does."""
    import json

    def one(t: str) -> str:
        run = json.loads(t)
        for s in run["steps"]:
            for k in ("args", "state", "meta"):
                try:
                    got = json.loads(s[k]) if s[k] else {}
                except ValueError:
                    got = {}
                s[k] = got if isinstance(got, dict) else {}
            if s["kind"] == "other":
                s["raw_action"] = f"{s['raw_tool']} {s['args']}"
        return digest_of(run)

    return text.map(one)


_STEP = ("idx", "kind", "thought", "raw_tool", "args", "raw_action", "observation", "exit_code", "files_touched", "error_fp", "error_kind", "is_test_run", "state", "meta")


def run_ids(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """run_key, run_id: a digest of a run's content. Outcome, repository and problem take no part; runs without steps have none. A task holds one run at a time."""
    own = steps.groupBy("run_key").agg(F.array_sort(F.collect_list(F.struct(*_STEP))).alias("steps"))
    r = runs.select("run_key", "framework", "instance_id", "upstream_id", F.col("model_patch").alias("patch"), "exit_status").join(own, "run_key", "left")
    body = F.struct("framework", "instance_id", "upstream_id", "steps", "patch", "exit_status")
    return r.filter("steps IS NOT NULL").select("run_key", _run_digest(F.to_json(body, {"ignoreNullFields": "false"})).alias("run_id"))


@F.pandas_udf(T.StringType())
def _finding_digest(text: pd.Series) -> pd.Series:
    import json

    def one(t: str) -> str:
        f = json.loads(t)
        f["detail"] = json.loads(f["detail"])
        return digest_of(f)

    return text.map(one)


_FINDING = ("detector", "category", "phase", "severity", "start", "end", "wasted_steps", "evidence", "confidence", "detail")


def with_identity(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """``findings`` with run_id, finding_signature, finding_id, legacy_finding_id, identity_version.

    The signature covers the version, mode, span, waste, severity, evidence and detail of the claim.
    """
    body = F.struct(F.lit(VERSION).alias("identity_version"), *_FINDING)
    f = findings.join(ids, "run_key").withColumn("finding_signature", _finding_digest(F.to_json(body, {"ignoreNullFields": "false"})))
    return f.withColumns(
        {
            "identity_version": F.lit(VERSION), "finding_id": F.concat_ws("|", F.lit(f"v{VERSION}"), "run_id", "detector", "finding_signature"),
            "legacy_finding_id": F.concat_ws("|", "instance_id", "detector", F.col("start").cast("string")),
        }
    )


def distinct_findings(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings with each finding_id once, one row: duplicates)."""
    names = [c for c in findings.columns if c != "finding_id"]
    once = findings.groupBy("finding_id").agg(F.min_by(F.struct(*names), F.struct("run_key", "start", "registry_ord", "emit_ord")).alias("f"), F.count("*").alias("n"))
    return once.select("finding_id", "f.*"), once.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))


def record_identity() -> Column:
    """A raw record's own id, or its instance and number of messages."""
    return F.coalesce(F.nullif("trajectory_id", F.lit("")), F.concat_ws("#", "instance_id", F.col("n_messages").cast("string")))


def exact_key(steps: DataFrame) -> DataFrame:
    """``steps`` with exact_key: an action with its whole payload. Edits are digests of their non-null arguments."""
    from stridelog.functions.text import action_key, short_hash

    s = steps.withColumn("_key", action_key()).withColumn("_edit", _edit_digest(F.when(F.col("kind") == "edit", F.col("args"))))
    key = (
        F.when(F.col("kind") == "edit", F.concat(F.lit("edit:#"), "_edit")).when(F.col("kind") == "shell", F.concat("_key", F.lit("#"), short_hash(F.coalesce("command", F.lit("")), 10)))
        .when((F.col("kind") == "read") & F.col("view_range").isNotNull(), F.concat("_key", F.lit("#"), short_hash(F.regexp_replace("view_range", r"\s", ""), 10))).otherwise(F.col("_key"))
    )
    return s.withColumn("exact_key", key).drop("_key", "_edit")


@F.pandas_udf(T.StringType())
def _edit_digest(args: pd.Series) -> pd.Series:
    import json

    def one(t: str) -> str:
        a = {k: v for k, v in json.loads(t).items() if v is not None}
        a["path"], a["verb"] = a.get("path") or "", a.get("verb") or "edit"
        return digest_of(a)[:16]

    return args.map(lambda t: one(t) if isinstance(t, str) else None)
