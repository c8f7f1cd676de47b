"""The four serializations, the loader and the gold sidecar."""

import json
import warnings

import pytest

from stridelog.operators.detectors import detect_all
from stridelog.sources.adapters import load
from stridelog.sources.gold import gold_coverage, load_gold
from stridelog.sources.records import numbered, read_records, wanted


def call(i, name, args, as_text=True):
    return {"id": i, "type": "function", "function": {"name": name, "arguments": json.dumps(args) if as_text else args}}


CALLS = {
    "trajectory_id": "t1", "instance_id": "acme__lib-1", "repo": "acme/lib", "resolved": True, "exit_status": "submit", "model_patch": "--- a/src/a.py\n+++ b/src/a.py\n@@ -1 +1 @@\n-x\n+y\n",
    "trajectory": [
        {"role": "system", "content": "rules"}, {"role": "user", "content": "fix it"},
        {"role": "assistant", "content": "look", "tool_calls": [call("c1", "execute_bash", {"command": "ls /testbed"}), call("c2", "str_replace_editor", {"command": "view", "path": "/testbed/src/a.py", "view_range": [1, 9]}, False)]},
        {"role": "tool", "tool_call_id": "c2", "content": "text"}, {"role": "tool", "tool_call_id": "c1", "content": "a.py\n[exit code: 0]"}, {"role": "tool", "tool_call_id": "zz", "content": "lost"},
        {"role": "assistant", "content": "  I think  "}, {"role": "assistant", "content": " "}, {"role": "user", "content": "go on"}, "junk",
        {"role": "assistant", "content": "", "tool_calls": [call("c3", "str_replace_editor", {"command": "str_replace", "path": "/testbed/src/a.py", "old_str": "x", "new_str": "y"})]},
        {"role": "tool", "tool_call_id": "c3", "content": "The file has been edited."},
        {"role": "assistant", "content": "test", "tool_calls": [call("c4", "execute_bash", {"command": "python -m pytest tests"})]},
        {"role": "tool", "tool_call_id": "c4", "content": "E   AssertionError: no\nFAILED tests/test_a.py::test_x - AssertionError: no\n[exit code: 1]"},
        {"role": "assistant", "content": None, "tool_calls": [call("c5", "browse", {"url": "u"}), call("c6", "task_tracker", {"command": "plan", "task_list": [1]}), call("c7", "finish", {"message": "done"})]},
    ],
}
LISTED = {
    "environment": "acme__lib-2", "info": {"exit_status": "submitted", "model_patch": "", "resolved": False}, "generated_patch": "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n",
    "trajectory": [
        {"action": "find_file \"a.py\" src\n", "observation": "Found", "thought": "t", "state": "{\"open_file\": \"n/a\"}"}, {"action": "open src/a.py 10", "observation": "[File]", "thought": "", "state": "{bad"},
        {"action": "edit 1:2\nnew\nend_of_edit", "observation": "[File]", "state": {"open_file": "/acme__lib/src/a.py"}}, {"action": "goto 5", "observation": "", "state": ""}, {"action": "create b.py", "observation": "[File]"},
        {"action": "search_dir 'def f' src", "observation": "none"}, {"action": "", "observation": "", "thought": "hmm"}, {"action": "python b.py && pytest -q", "observation": "Traceback (most recent call last):\nValueError: bad 0x1f"}, {"action": "submit", "observation": ""},
    ],
}
HISTORY = {
    "instance_id": "acme__lib-3", "target": 1,
    "history": [
        {"role": "system", "content": "s", "message_type": "system_prompt"}, {"role": "user", "content": "problem"},
        {"role": "assistant", "content": "c", "thought": "th", "action": "ignored", "tool_calls": [call("a", "open", {"path": "/repo/k.py"})]}, {"role": "tool", "content": "x\n(Open file: /repo/k.py)", "tool_call_ids": ["a"]},
        {"role": "assistant", "content": "", "tool_calls": [call("b", "edit", {"search": "o", "replace": "n"})]}, {"role": "tool", "content": "(Open file: n/a)", "tool_call_id": "b"},
        {"role": "assistant", "content": "say", "action": "edit 3:4\nq\nend_of_edit"}, {"role": "assistant", "content": "just words"}, {"role": "assistant", "content": "x", "tool_calls": [call("c", "bash", {"cmd": "pytest"}), call("d", "submit", {})]},
    ],
}
STREAM = {
    "instance_id": "acme__lib-4", "target": False, "exit_status": "submitted", "model_name": "m",
    "trajectory": [
        {"role": "system", "text": "sys"}, {"role": "user", "text": "issue"},
        {"role": "ai", "text": "first\n```\nls\n```\nthen\n```bash\nopen src/m.py\n```"}, {"role": "user", "text": "[File]\n(Open file: /acme__lib/src/m.py)"},
        {"role": "ai", "text": "fix\n```\nedit 1:1\nz\nend_of_edit\n```\n"}, {"role": "ai", "text": "only words"}, {"role": "user", "text": "seen"}, {"role": "user", "text": "not attached"}, {"role": "ai", "text": "```\nsubmit\n```"},
    ],
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "runs.jsonl").write_text("﻿" + "\n\n".join(json.dumps(x) for x in (CALLS, LISTED, HISTORY, STREAM)) + "\n", encoding="utf-8")
    runs, steps = load(spark, str(root / "runs.jsonl"))
    runs = {r.instance_id: r for r in runs.collect()}
    by = {}
    for s in steps.orderBy("run_key", "idx").collect():
        by.setdefault(s.run_key, []).append(s)
    return runs, {i: by[r.run_key] for i, r in runs.items()}, root


def test_calls(loaded):
    runs, steps, _ = loaded
    r, s = runs["acme__lib-1"], steps["acme__lib-1"]
    assert (r.framework, r.resolved, r.problem_statement, r.exit_status, r.upstream_id) == ("openhands", True, "fix it", "submit", "t1")
    assert [x.kind for x in s] == ["shell", "read", "thought", "edit", "shell", "other", "plan", "submit"]
    assert s[0].observation == "a.py\n[exit code: 0]" and s[0].exit_code == 0 and s[0].error_kind is None and s[0].thought == "look"
    assert (s[1].path, s[1].observation, json.loads(s[1].view_range), s[1].files_touched) == ("src/a.py", "text", [1, 9], ["src/a.py"])
    assert s[2].raw_tool == "think" and s[2].raw_action == s[2].thought == "  I think  "
    assert (s[3].verb, s[3].old_str, s[3].new_str, s[3].raw_action) == ("str_replace", "x", "y", "str_replace src/a.py")
    assert (s[4].is_test_run, s[4].exit_code, s[4].error_kind) == (True, 1, "test_failure")
    assert s[5].raw_tool == "browse" and json.loads(s[5].args) == {"url": "u"} and s[5].observation is None
    assert json.loads(s[6].args) == {"verb": "plan", "task_list": [1]} and s[7].raw_action == "finish"
    assert json.loads(s[3].args) == {"path": "src/a.py", "verb": "str_replace", "view_range": None, "old_str": "x", "new_str": "y", "file_text": None, "insert_line": None}


def test_listed(loaded):
    runs, steps, _ = loaded
    r, s = runs["acme__lib-2"], steps["acme__lib-2"]
    assert (r.framework, r.resolved, r.exit_status, r.model_patch.startswith("diff")) == ("sweagent", False, "submitted", True)
    assert [x.kind for x in s] == ["search", "read", "edit", "read", "edit", "search", "thought", "shell", "submit"]
    assert (s[0].pattern, s[0].path, s[0].verb) == ("a.py", "src", "find_file")
    assert (s[1].path, s[1].verb, json.loads(s[1].args)["line"]) == ("src/a.py", "view", "10")
    assert (s[2].path, s[2].new_str, json.loads(s[2].args)["range"]) == ("src/a.py", "new", "1:2")
    assert (s[3].path, s[3].verb, s[3].raw_tool) == ("src/a.py", "navigate", "goto")
    assert (s[4].path, s[4].verb) == ("b.py", "create") and (s[5].pattern, s[5].path) == ("def f", "src")
    assert s[6].raw_action == "" and s[6].thought == "hmm" and s[7].is_test_run and s[7].error_fp == "value_error:ValueError: bad 0xADDR"


def test_history(loaded):
    runs, steps, _ = loaded
    r, s = runs["acme__lib-3"], steps["acme__lib-3"]
    assert (r.framework, r.resolved, r.problem_statement) == ("sweagent", True, "problem")
    assert [x.kind for x in s] == ["read", "edit", "edit", "thought", "shell", "submit"]
    assert (s[0].path, s[0].thought) == ("k.py", "th") and (s[1].path, s[1].old_str, s[1].new_str) == ("k.py", "o", "n")
    assert s[1].observation == "(Open file: n/a)" and s[2].path == "k.py" and s[2].observation is None and s[3].raw_action == "just words" and s[4].is_test_run


def test_stream(loaded):
    runs, steps, _ = loaded
    r, s = runs["acme__lib-4"], steps["acme__lib-4"]
    assert (r.framework, r.resolved, r.problem_statement) == ("sweagent", False, "issue")
    assert [x.kind for x in s] == ["read", "edit", "thought", "submit"]
    assert s[0].thought == "first\n```\nls\n```\nthen" and s[0].path == "src/m.py" and s[0].observation.startswith("[File]")
    assert (s[1].path, s[1].new_str, s[1].observation) == ("src/m.py", "z", None) and s[2].observation == "seen" and s[3].observation is None


def test_repeated_call_ids(spark, tmp_path):
    rec = {"trajectory": [
        {"role": "assistant", "tool_calls": [call("x", "execute_bash", {"command": "a"})]}, {"role": "tool", "tool_call_id": "x", "content": "1"}, {"role": "tool", "tool_call_id": "x", "content": "2"},
        {"role": "assistant", "tool_calls": [call("x", "execute_bash", {"command": "b"}), call("y", "execute_bash", {"command": "c"})]}, {"role": "tool", "tool_call_id": "x", "content": "3"},
    ]}
    (tmp_path / "one.json").write_text(json.dumps([rec, rec]))
    runs, steps = load(spark, str(tmp_path / "one.json"))
    assert runs.count() == 2 and {r.instance_id for r in runs.collect()} == {"unknown"}
    got = [(r.command, r.observation) for r in steps.orderBy("run_key", "idx").collect()]
    assert got == [("a", "2"), ("b", "3"), ("c", None)] * 2


def test_loader(spark, tmp_path, loaded):
    _, _, root = loaded
    path = str(root / "runs.jsonl")
    runs, _ = load(spark, path, limit=2)
    assert {r.instance_id for r in runs.collect()} == {"acme__lib-1", "acme__lib-2"}
    assert load(spark, path, limit=0)[0].count() == 0
    assert [r.pos for r in numbered(read_records(spark, path)).orderBy("pos").collect()] == [0, 1, 2, 3]
    assert [r.instance_id for r in wanted(read_records(spark, path)).collect()] == ["acme__lib-1", None, "acme__lib-3", "acme__lib-4"]
    for bad in ({"limit": -1}, {"framework": "none"}, {"on_empty": "x"}):
        with pytest.raises(ValueError):
            load(spark, path, **bad)
    (tmp_path / "odd.jsonl").write_text('{"unrelated": 1}\n')
    with pytest.raises(Exception, match="no adapter"):
        load(spark, str(tmp_path / "odd.jsonl"))[0].collect()
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception, match="invalid JSON"):
        read_records(spark, str(tmp_path / "bad.jsonl")).collect()
    assert read_records(spark, str(tmp_path / "bad.jsonl"), strict=False).count() == 1
    none = {"instance_id": "e", "trajectory": [{"role": "system", "text": "s"}, {"role": "user", "text": "u"}]}
    (tmp_path / "none.jsonl").write_text(json.dumps(none) + "\n" + json.dumps(STREAM) + "\n")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert load(spark, str(tmp_path / "none.jsonl"))[0].count() == 1
    assert any("zero steps" in str(w.message) for w in seen)
    with pytest.raises(Exception, match="zero steps"):
        load(spark, str(tmp_path / "none.jsonl"), on_empty="error")[0].collect()


def test_gold(spark, tmp_path, loaded):
    _, _, root = loaded
    (tmp_path / "gold.jsonl").write_text("\n".join(json.dumps(x) for x in ({"instance_id": "acme__lib-1", "files": ["z.py"]}, {"instance_id": "acme__lib-1", "files": ["src/b.py"]}, {"instance_id": "acme__lib-4", "patch": "--- a/src/m.py\n+++ b/src/m.py\n"})))
    assert {r.instance_id: r.files for r in load_gold(spark, str(tmp_path / "gold.jsonl")).collect()} == {"acme__lib-1": ["src/b.py"], "acme__lib-4": ["src/m.py"]}
    runs, steps = load(spark, str(root / "runs.jsonl"), gold=str(tmp_path / "gold.jsonl"))
    assert tuple(gold_coverage(runs).first()) == (4, 2, 0.5)
    assert {(r.instance_id, r.pattern) for r in detect_all(steps, runs, only=["localization_failure"]).collect()} == {("acme__lib-1", "gold_miss"), ("acme__lib-4", "gold_miss")}
    (tmp_path / "bad.jsonl").write_text('{"files": []}')
    with pytest.raises(Exception, match="no instance_id"):
        load_gold(spark, str(tmp_path / "bad.jsonl")).collect()
