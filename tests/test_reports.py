"""Reports of detected runs: the same rows as from findings, made in one pass over the steps."""

import pytest
from test_detectors import CASES, frames

from stridelog.operators import detectors, metrics
from stridelog.plans import driver
from stridelog.sources import sinks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df):
    """Reads of a file in a plan, those below a cached table included."""
    return plan(df).count("Relation [") - plan(df).count("InMemoryRelation [") + plan(df).count("FileScan")


@pytest.fixture(scope="module")
def both(spark):
    steps, runs = frames(spark, CASES)
    return metrics.waste_reports(runs, steps, detectors.detect_all(steps, runs)), metrics.detected_reports(runs, steps)


def test_same_reports(both):
    a, b = ({r.run_key: r.asDict() for r in df.collect()} for df in both)
    assert len(a) == len(CASES) and a == b


@pytest.mark.parametrize("name", ["top_quantile_failures", "auc", "category_stats"])
def test_steps_are_read_once(spark, name):
    one = driver.QUERIES[name](spark, SF)
    each = plan(one).count("InMemoryRelation") or 1
    assert scans(one) == 2 * each  # the steps, and whose they are


def test_export_reads_reports_once(spark):
    steps, runs = frames(spark, {k: CASES[k] for k in ("streak", "empty", "lost")})
    rows = sinks.csv_rows(metrics.detected_reports(runs, steps))
    assert "InMemoryRelation" in plan(rows) and rows.columns == [*sinks.CSV, "edit_error", "lost_edit", "termination_anomaly"]
    assert {r.instance_id: (r.edit_error, r.lost_edit, r.termination_anomaly) for r in rows.collect()} == {"streak": (2, None, None), "empty": (None, None, 3), "lost": (None, 1, None)}


def test_steps_are_exchanged_once(spark):
    text = driver.QUERIES["edit_sessions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1  # before their texts are judged, in a given number of parts
