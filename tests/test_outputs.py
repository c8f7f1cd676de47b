"""Reports, writers, identities, streaming and the command line over a few runs."""

import json

import pytest
from test_adapters import CALLS, LISTED, STREAM

from stridelog import report
from stridelog.operators import detectors, metrics
from stridelog.operators.identity import digest_of, distinct_findings, run_ids, with_identity
from stridelog.sources import sinks
from stridelog.sources.adapters import load


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("out")
    (root / "in").mkdir()
    path = root / "in" / "runs.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in (CALLS, LISTED, STREAM, STREAM)))
    runs, steps = load(spark, str(path))
    runs, steps = runs.persist(), steps.persist()
    found = detectors.detect_all(steps, runs).persist()
    return root, str(path), runs, steps, found, metrics.waste_reports(runs, steps, found).persist()


def test_identity(made):
    _, _, runs, steps, found, _ = made
    ids = run_ids(runs, steps)
    named = with_identity(found, ids)
    once, dup = distinct_findings(named)
    total, left = named.count(), once.count()
    assert dup.first()[0] == total - left > 0  # the same run twice makes the same claims
    assert all(r.finding_id.startswith(f"v2|{r.run_id}|{r.detector}|") for r in once.collect())
    assert digest_of({"b": 1, "a": "é"}) == digest_of({"a": "é", "b": 1})


def test_writers(spark, made):
    root, _, _, _, found, reports = made
    assert sinks.write_json(sinks.export_rows(reports, found), str(root / "a.json")) == 4
    rows = json.loads((root / "a.json").read_text())
    assert {r["instance_id"] for r in rows} == {"acme__lib-1", "acme__lib-2", "acme__lib-4"} and all(0 <= r["wasted_step_ratio"] <= 1 for r in rows)
    sinks.write_jsonl(sinks.export_rows(reports), str(root / "b"))
    assert spark.read.json(str(root / "b")).count() == 4
    sinks.write_csv(reports, str(root / "c"))
    assert spark.read.option("header", True).csv(str(root / "c")).columns[: len(sinks.CSV)] == list(sinks.CSV)
    labels = spark.createDataFrame([("i", "valid", "r")], "finding_id string, verdict string, reason string")
    assert sinks.write_labels(labels, str(root / "l")) and not sinks.write_labels(labels, str(root / "l"))
    with pytest.raises(FileExistsError):
        sinks.write_labels(labels.union(labels), str(root / "l"))


def test_console(spark, made):
    _, path, *_ = made
    text = report.replay(spark, path, instance="acme__lib-2", tier=None)
    assert text.startswith("acme__lib-2") and "view src/a.py" in text
    with pytest.raises(LookupError):
        report.replay(spark, path, index=9)
    text, summary = report.diagnose(spark, path)
    assert summary["n_trajectories"] == 4 and "resolved" in text


def test_stream(spark, made):
    from stridelog.streaming.live import stream_steps

    root, *_ = made
    q = stream_steps(spark, str(root / "in")).writeStream.format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("live").count() > 0
    q.stop()
