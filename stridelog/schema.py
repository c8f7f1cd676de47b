"""The normalized tables."""

from __future__ import annotations

KINDS = ("thought", "read", "edit", "shell", "search", "plan", "submit", "other")
#: Only these kinds of steps carry errors and exit codes.
ERROR_BEARING = ("shell", "edit", "other")
CATEGORIES = ("termination_anomaly", "edit_error", "lost_edit", "submit_despite_failure", "localization_failure", "verification_gap")

#: args, state and meta are canonical JSON texts, so 10 and "10" stay apart.
STEPS = (
    "run_key string, idx int, kind string, thought string, raw_tool string, raw_action string, args string, path string, verb string, command string, pattern string, old_str string, new_str string, "
    "file_text string, view_range string, observation string, files_touched array<string>, state string, meta string"
)
DERIVED = "exit_code int, error_fp string, error_kind string, is_test_run boolean"
RUNS = (
    "run_key string, instance_id string, framework string, resolved boolean, resolved_raw string, repo string, problem_statement string, model_patch string, exit_status string, upstream_id string, "
    "gold_files array<string>, meta string"
)
