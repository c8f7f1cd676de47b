"""Sequence scenarios: steps of small runs and what the rules say about them."""

import pytest

from stridelog.operators.detectors import describe, detect_all, filter_findings
from stridelog.operators.sequence import dense_groups, edit_sessions, with_flags
from stridelog.schema import DERIVED, RUNS, STEPS

PATCH = "diff --git a/src/core.py b/src/core.py\n--- a/src/core.py\n+++ b/src/core.py\n@@ -1 +1 @@\n-a\n+b\n"


def shell(command, obs="ok", code=None, kind=None):
    return {"kind": "shell", "command": command, "observation": obs, "exit_code": code, "error_kind": kind}


def edit(path, verb="str_replace", obs="File updated.", old=None, fp=None):
    return {"kind": "edit", "path": path, "verb": verb, "observation": obs, "old_str": old, "files_touched": [path], "error_fp": fp}


SUBMIT = {"kind": "submit", "observation": ""}
NO = "ERROR: No replacement was performed"
TEST = shell("pytest -q")

#: name -> (steps, run's columns, expected (pattern, start, end, wasted))
CASES = {
    "unverified": ([edit("src/a.py"), SUBMIT], {}, [("never_verified", 0, 1, [])]),
    "same_region": ([edit("src/a.py", old="x"), TEST, edit("src/a.py", old="x"), SUBMIT], {}, [("stale_verification", 1, 3, [])]),
    "test_first": ([TEST, edit("src/a.py"), SUBMIT], {}, [("stale_verification", 0, 2, [])]),
    "checked": ([edit("src/a.py"), TEST, edit("src/a.py"), TEST, SUBMIT], {}, []),
    "late_refused": ([edit("src/a.py"), TEST, edit("src/a.py", obs=NO), SUBMIT], {}, []),
    "late_readme": ([edit("src/a.py"), TEST, edit("README.md"), edit("tests/test_a.py"), SUBMIT], {}, []),
    "own_script": ([edit("probe.py", verb="create"), edit("src/a.py"), shell("python probe.py"), edit("src/a.py"), shell("cd /repo && python /repo/probe.py"), SUBMIT], {}, []),
    "their_script": ([edit("src/a.py"), shell("python tool.py"), SUBMIT], {}, [("never_verified", 0, 2, [])]),
    "made_later": ([edit("src/a.py"), shell("python probe.py"), edit("probe.py", verb="create"), SUBMIT], {}, []),
    "streak": ([edit("src/a.py", obs=NO), edit("src/a.py", obs=NO), edit("src/a.py", obs=NO), edit("src/a.py"), TEST, SUBMIT], {}, [("rejected_edit_streak", 0, 2, [1, 2])]),
    "healed": ([edit("a/x.py", obs=NO), edit("a/x.py", obs=NO), edit("a/x.py"), edit("a/x.py", obs=NO), edit("a/x.py", obs=NO), TEST, SUBMIT], {}, []),
    "fp_only": ([edit("a/x.py", fp="edit_rejected:q"), edit("a/x.py", fp="edit_rejected:q"), edit("a/x.py", fp="edit_rejected:q"), TEST, SUBMIT], {}, []),
    "capped": ([TEST], {"exit_status": "Agent reached Maximum Iteration in state"}, [("iteration_cap", 0, 0, [])]),
    "no_submit": ([TEST, TEST], {}, [("no_submit", 1, 1, [])]),
    "said_submitted": ([TEST], {"exit_status": "Submitted (late)"}, []),
    "scratch_patch": ([edit("probe.py", verb="create"), shell("python probe.py"), SUBMIT], {"model_patch": PATCH.replace("src/core.py", "probe.py")}, [("patch_ignores_source", 0, 0, [])]),
    "real_check": ([edit("hooks/check_yaml.py"), TEST, SUBMIT], {"model_patch": PATCH.replace("src/core.py", "hooks/check_yaml.py")}, []),
    "empty": ([TEST, TEST, SUBMIT], {"model_patch": ""}, [("empty_patch", 0, 2, [0, 1, 2])]),
    "no_patch": ([TEST, SUBMIT], {"model_patch": None}, []),
    "lost": ([edit("src/core.py"), edit("src/util.py"), shell("git checkout src/util.py"), TEST, SUBMIT], {"model_patch": PATCH}, [("edit_missing_from_patch", 1, 1, [1])]),
    "suffix": ([edit("core.py"), TEST, SUBMIT], {"model_patch": PATCH}, []),
    "despite": ([edit("src/core.py"), shell("pytest", code=1, kind="test_failure"), SUBMIT], {"model_patch": PATCH}, [("submitted_after_failed_verification", 1, 2, [])]),
    "gold": ([edit("src/a.py"), TEST, SUBMIT], {"model_patch": PATCH.replace("core", "a"), "gold_files": ["/testbed/src/b.py"]}, [("gold_miss", 0, 0, [0])]),
    "gold_hit": ([edit("src/core.py"), TEST, SUBMIT], {"model_patch": PATCH, "gold_files": ["src/core.py", "z.py"]}, []),
}


def frames(spark, cases):
    schema = f"{STEPS}, {DERIVED}"
    names = [c.split()[0] for c in schema.split(", ")]
    rows, runs = [], []
    for key, (steps, run, _) in cases.items():
        for i, s in enumerate(steps):
            base = {"run_key": key, "idx": i, "is_test_run": s.get("command") == TEST["command"] or s.get("command") == "pytest", "files_touched": []} | s
            rows.append(tuple(base.get(n) for n in names))
        base = {"run_key": key, "instance_id": key, "framework": "x", "gold_files": []} | run
        runs.append(tuple(base.get(c.split()[0]) for c in RUNS.split(", ")))
    return spark.createDataFrame(rows, schema), spark.createDataFrame(runs, RUNS)


@pytest.fixture(scope="module")
def found(spark):
    steps, runs = frames(spark, CASES)
    return detect_all(steps, runs).orderBy("run_key", "start", "category", "registry_ord", "emit_ord").collect()


@pytest.mark.parametrize("case", list(CASES))
def test_scenario(found, case):
    assert [(r.pattern, r.start, r.end, list(r.wasted_steps)) for r in found if r.run_key == case] == CASES[case][2]


def test_evidence_and_detail(found):
    by = {(r.run_key, r.pattern): r for r in found}
    assert by["lost", "edit_missing_from_patch"].evidence.endswith("(later discarded?): src/util.py edited at step 1")
    assert '"had_revert_after_edit":true' in by["lost", "edit_missing_from_patch"].detail
    assert by["gold", "gold_miss"].evidence == "agent edited ['src/a.py'] but the gold patch touches ['src/b.py']"
    assert by["scratch_patch", "patch_ignores_source"].evidence.endswith("('probe.py',)")
    assert by["despite", "submitted_after_failed_verification"].evidence == "last verification before submit (step 1) failed: test_failure (exit 1); submitted at step 2 with no later passing check"


def test_selection(spark):
    steps, runs = frames(spark, {k: CASES[k] for k in ("unverified", "empty", "streak")})
    assert {r.detector for r in detect_all(steps, runs, tier="core").collect()} == {"termination_anomaly"}
    assert {r.detector for r in detect_all(steps, runs, only=["edit_error"], min_repeats=2).collect()} == {"edit_error"}
    assert detect_all(steps, runs, only=["edit_error"], min_repeats=4).count() == 0
    every = detect_all(steps, runs)
    assert filter_findings(every, min_confidence=0.95).count() == 1
    assert filter_findings(every, min_severity="high", categories=["verification_gap"]).count() == 1
    assert [d[0] for d in describe()] == sorted(d[0] for d in describe())
    with pytest.raises(ValueError):
        detect_all(steps, runs, only=["nothing"])


def test_dense_groups(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0, 1, 2, 30, 33, 39, 40],), ([0, 9, 10, 19, 20],), ([],), ([5],)], "p array<int>")
    assert [r[0] for r in df.select(dense_groups(F.col("p"), 3, 10)).collect()] == [[[0, 1, 2], [30, 33, 39]], [], [], []]


def test_sessions(spark):
    steps = [edit("a.c", old="f"), edit("a.c", old="f"), edit("a.c", old="g"), TEST, edit("a.c", old="g"), edit("b.c", old="g"), edit("b.c", old="g", obs=NO)]
    s, _ = frames(spark, {"r": (steps, {}, [])})
    assert [r.idx for r in edit_sessions(with_flags(s)).filter("session").orderBy("idx").collect()] == [0, 2, 4, 5]
