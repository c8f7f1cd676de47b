"""The engine's operators over the driver's tables, each with the SQL that gives the same rows.

The tables hold no agent logs, so a fixed projection of ``events`` makes steps and runs (one run a user), conversations become a role/text stream, and labels
joined to documents become verdicts. The SQL states what each input must give; it shares no code with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelog.functions import predicates as P
from stridelog.functions import text as X
from stridelog.functions.errors import exit_code, with_errors
from stridelog.operators import detectors as D
from stridelog.operators import evaluation as V
from stridelog.operators import metrics as M
from stridelog.operators import sampling as L
from stridelog.operators import sequence as O
from stridelog.sources.adapters import derived, parsed, steps_of
from stridelog.sources.gold import gold_coverage
from stridelog.sources.records import class_quota, from_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- the projection

COMMANDS = ["pytest -q", "python probe.py", "git checkout src/util.py", "ls -la src", "pip install x", 'cat a | grep "b;c"; tox', "python -m unittest --help", "cd /repo && make test"]
RESULTS = ["ok", "Traceback (most recent call last):\nValueError: bad value 12345", "E   AssertionError: x\n[exit code: 1]", "all passed\n[exit code: 0]", "bash: foo: command not found"]
REFUSED = "ERROR: No replacement was performed"


def _diff(path: str) -> str:
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1 +1 @@\n-a\n+b\n"


def _pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the normalized schema, one run a user, in order of time."""
    from pyspark.sql import Window

    w, uid, eid, k = Window.partitionBy("run_key").orderBy("ts", "event_id"), F.col("user_id"), F.col("event_id"), F.col("k")
    e = table(spark, sf_dir, "events").select(uid.cast("string").alias("run_key"), "user_id", "event_id", "ts", "event_type", F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"))
    # the only exchange of steps; a given number, as what is made of these few bytes decides the work of a task
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "run_key")
    e = e.withColumn("idx", F.row_number().over(w) - 1).withColumn("last", F.lead("event_id").over(w).isNull())
    kind = F.when(F.col("last") & (uid % 4 != 0), "submit").when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "signup", "search").otherwise("shell")
    e = e.withColumn("kind", kind)
    edit, kind = F.col("kind") == "edit", F.col("kind")
    path = F.when(edit, F.when(eid % 7 == 0, "probe.py").when(eid % 11 == 0, "README.md").when(k % 2 == 0, "src/core.py").otherwise("src/util.py")).when(kind == "read", F.concat(F.lit("src/m"), (k % 9).cast("string"), F.lit(".py")))
    s = e.select(
        "run_key", "idx", "kind", F.lit(None).cast("string").alias("thought"), "kind", F.lit(None).cast("string").alias("raw_action"), path.alias("path"), F.when(edit, F.when(eid % 7 == 0, "create").otherwise("str_replace")).when(kind == "read", "view").alias("verb"),
        F.when(kind == "shell", _pick(COMMANDS, k % 8)).alias("command"), F.when(kind == "search", F.concat(F.lit("find "), k.cast("string"))).alias("pattern"), F.when(edit, F.concat(F.lit("f"), (k % 3).cast("string"))).alias("old_str"),
        F.when(edit, F.when(eid % 4 != 0, REFUSED).otherwise("File updated.")).when(kind == "shell", _pick(RESULTS, k % 5)).when(kind == "submit", "").otherwise(F.concat(F.lit("content "), k.cast("string"))).alias("observation"), "event_id",
    )
    s = s.select("run_key", "idx", e["kind"].alias("kind"), "thought", F.lit("tool").alias("raw_tool"), "raw_action", F.lit("{}").alias("args"), "path", "verb", "command", "pattern", "old_str", "observation", F.when(F.col("path").isNotNull(), F.array("path")).otherwise(F.array().cast("array<string>")).alias("files_touched"), "event_id")
    return derived(s)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        u.cast("string").alias("run_key"), F.concat(F.lit("acme__lib-"), u.cast("string")).alias("instance_id"), F.when(u % 2 == 0, "openhands").otherwise("sweagent").alias("framework"), F.when(u % 11 != 0, u % 2 == 0).alias("resolved"),
        F.when(u % 7 == 0, F.concat(F.lit("acme/"), (u % 3).cast("string"))).alias("repo"), F.when(u % 5 == 1, "").when(u % 5 == 2, "  ").when(u % 5 == 3, _diff("src/core.py")).when(u % 5 == 4, _diff("probe.py")).alias("model_patch"),
        F.when(u % 6 == 0, "submitted").when(u % 6 == 1, "Agent reached maximum iteration").alias("exit_status"), F.when(u % 3 == 1, F.array(F.lit("src/core.py"))).when(u % 3 == 2, F.array(F.lit("/testbed/src/other.py"))).otherwise(F.array().cast("array<string>")).alias("gold_files"),
    )


STEPS_SQL = """
e AS (SELECT user_id, event_id, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx,
  lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS fin FROM events),
a AS (SELECT CAST(user_id AS VARCHAR) AS run_key, user_id AS u, event_id, k, idx, CASE WHEN fin AND user_id % 4 <> 0 THEN 'submit' WHEN event_type = 'view' THEN 'read' WHEN event_type = 'purchase' THEN 'edit' WHEN event_type = 'signup' THEN 'search' ELSE 'shell' END AS kind FROM e),
b AS (SELECT *, CASE WHEN kind <> 'edit' THEN NULL WHEN event_id % 7 = 0 THEN 'probe.py' WHEN event_id % 11 = 0 THEN 'README.md' WHEN k % 2 = 0 THEN 'src/core.py' ELSE 'src/util.py' END AS path,
  kind = 'edit' AND event_id % 4 <> 0 AS rejected, kind = 'edit' AND event_id % 4 = 0 AS landed, kind = 'shell' AND k % 8 IN (0, 5, 7) AS test, kind = 'shell' AND k % 5 IN (1, 2, 4) AS bad FROM a),
c AS (SELECT *, bool_or(landed AND event_id % 7 = 0) OVER (PARTITION BY run_key) AS made FROM b),
s AS (SELECT *, test OR (kind = 'shell' AND k % 8 = 1 AND made) AS verifies, landed AND path IN ('src/core.py', 'src/util.py') AS ev FROM c),
v AS (SELECT *, sum(CASE WHEN verifies THEN 1 ELSE 0 END) OVER (PARTITION BY run_key ORDER BY idx) AS cv FROM s),
ses AS (SELECT run_key, idx, p IS NULL OR p <> path OR r <> k % 3 OR q <> cv AS session FROM (SELECT *, lag(path) OVER w AS p, lag(k % 3) OVER w AS r, lag(cv) OVER w AS q FROM v WHERE ev WINDOW w AS (PARTITION BY run_key ORDER BY idx)))"""

FOUND_SQL = (
    STEPS_SQL
    + """,
t AS (SELECT run_key, any_value(u) AS u, CAST(count(*) AS INT) AS n, max(CASE WHEN kind = 'submit' THEN idx END) AS sub, min(CASE WHEN kind = 'edit' THEN idx END) AS e0, max(CASE WHEN kind = 'edit' THEN idx END) AS e1, any_value(made) AS made,
  coalesce(list(idx ORDER BY idx) FILTER (WHERE kind = 'edit'), []) AS edits, max(CASE WHEN verifies THEN idx END) AS lv, max(CASE WHEN ev THEN idx END) AS le FROM s GROUP BY run_key),
t2 AS (SELECT t.*, coalesce(x.n_ses, 0) AS n_ses, x.s0, y.ci, y.bad, z.lost FROM t
  LEFT JOIN (SELECT run_key, count(*) AS n_ses, min(idx) AS s0 FROM ses WHERE session GROUP BY run_key) x USING (run_key)
  LEFT JOIN (SELECT s.run_key, max(s.idx) AS ci, arg_max(s.bad, s.idx) AS bad FROM s JOIN t ON s.run_key = t.run_key WHERE s.verifies AND s.idx < t.sub GROUP BY s.run_key) y USING (run_key)
  LEFT JOIN (SELECT run_key, list(idx ORDER BY idx) AS lost FROM s WHERE landed AND path IN ('src/core.py', 'src/util.py') AND (u % 5 = 4 OR path <> 'src/core.py') GROUP BY run_key) z USING (run_key)),
pos AS (SELECT run_key, path, list(idx ORDER BY idx) AS p FROM s WHERE rejected GROUP BY run_key, path),
walk AS (SELECT run_key, path, p, CAST(1 AS BIGINT) AS i, CAST(NULL AS INT[]) AS span FROM pos UNION ALL
  SELECT run_key, path, p, CASE WHEN n >= 3 THEN i + n ELSE i + 1 END, CASE WHEN n >= 3 THEN p[i:i + n - 1] END FROM (SELECT *, len(list_filter(p[i:], lambda x: x - p[i] < 10)) AS n FROM walk WHERE i <= len(p))),
streak AS (SELECT w.run_key, w.path, w.span FROM walk w WHERE span IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.run_key = w.run_key AND s.landed AND s.path = w.path AND s.idx BETWEEN w.span[1] AND w.span[-1])),
found AS (
  SELECT run_key, u, 'verification_gap' AS detector, 'never_verified' AS pattern, 'high' AS severity, 0 AS sev, CAST(0.9 AS DOUBLE) AS confidence, s0 AS a, coalesce(sub, n - 1) AS b, CAST([] AS INT[]) AS wasted, 0 AS ro, 0 AS eo FROM t2 WHERE lv IS NULL AND n_ses > 0
  UNION ALL SELECT run_key, u, 'verification_gap', 'stale_verification', 'medium', 1, 0.8, lv, coalesce(sub, n - 1), [], 0, 1 FROM t2 WHERE le > lv AND lv < coalesce(sub, n - 1)
  UNION ALL SELECT run_key, u, 'submit_despite_failure', 'submitted_after_failed_verification', 'high', 0, 0.8, ci, sub, [], 1, 0 FROM t2 WHERE sub IS NOT NULL AND n_ses > 0 AND bad
  UNION ALL SELECT k.run_key, t.u, 'edit_error', 'rejected_edit_streak', 'medium', 1, 0.8, k.span[1], k.span[-1], k.span[2:], 2, 0 FROM streak k JOIN t USING (run_key)
  UNION ALL SELECT run_key, u, 'localization_failure', 'gold_miss', 'high', 0, 0.95, coalesce(e0, 0), coalesce(e1, n - 1), edits, 3, 0 FROM t2 WHERE u % 3 <> 0 AND NOT (u % 3 = 1 AND u % 5 = 3)
  UNION ALL SELECT run_key, u, 'lost_edit', 'edit_missing_from_patch', 'medium', 1, 0.75, lost[1], lost[-1], lost, 4, 0 FROM t2 WHERE u % 5 IN (3, 4) AND lost IS NOT NULL
  UNION ALL SELECT run_key, u, 'termination_anomaly', 'empty_patch', 'high', 0, 0.98, 0, n - 1, CAST(range(n) AS INT[]), 5, 0 FROM t2 WHERE u % 5 IN (1, 2)
  UNION ALL SELECT run_key, u, 'termination_anomaly', 'iteration_cap', 'high', 0, 0.95, n - 1, n - 1, [], 5, 1 FROM t2 WHERE u % 6 = 1
  UNION ALL SELECT run_key, u, 'termination_anomaly', 'patch_ignores_source', 'high', 0, 0.9, e0, e1, edits[2:], 5, 2 FROM t2 WHERE u % 5 = 4 AND made
  UNION ALL SELECT run_key, u, 'termination_anomaly', 'no_submit', 'medium', 1, 0.85, n - 1, n - 1, [], 5, 3 FROM t2 WHERE u % 6 > 1 AND sub IS NULL)"""
)
_SHOWN = "run_key, detector, pattern, severity, confidence, a AS start_step, b AS end_step, wasted"
WASTE_SQL = FOUND_SQL + """,
waste AS (SELECT run_key, step, detector AS category FROM (SELECT *, row_number() OVER (PARTITION BY run_key, step ORDER BY sev, a, detector, ro, eo) AS nth FROM (SELECT *, unnest(wasted) AS step FROM found)) WHERE nth = 1),
shape AS (SELECT run_key, any_value(u) AS u, count(*) AS total_steps, count(*) FILTER (WHERE kind = 'edit') AS source_edits, count(*) FILTER (WHERE test) AS test_runs, count(DISTINCT ok) AS novel, count(ok) AS results FROM (
  SELECT *, CASE WHEN kind = 'edit' AND rejected THEN 'no' WHEN kind = 'edit' THEN 'yes' WHEN kind = 'shell' THEN 's' || k % 5 WHEN kind = 'submit' THEN NULL ELSE 'c' || k END AS ok FROM s) GROUP BY run_key),
rep AS (SELECT h.run_key, h.u, CASE WHEN h.u % 11 <> 0 THEN h.u % 2 = 0 END AS resolved, CASE WHEN h.u % 2 = 0 THEN 'openhands' ELSE 'sweagent' END AS framework, total_steps, coalesce(w, 0) AS wasted_steps, coalesce(w, 0) / total_steps AS wasted_step_ratio, coalesce(nf, 0) AS n_findings, source_edits, test_runs,
  test_runs / greatest(1, source_edits) AS tests_per_source_edit, test_runs / total_steps AS test_run_ratio, coalesce(novel / nullif(results, 0), 0.0) AS novel_observation_ratio FROM shape h
  LEFT JOIN (SELECT run_key, count(*) AS w FROM waste GROUP BY run_key) USING (run_key) LEFT JOIN (SELECT run_key, count(*) AS nf FROM found GROUP BY run_key) USING (run_key)),
hits AS (SELECT DISTINCT run_key, u, detector AS category FROM found),
lab AS (SELECT run_key, u, CASE WHEN resolved IS NULL THEN 'unknown' WHEN resolved THEN 'resolved' ELSE 'unresolved' END AS label FROM rep)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()} {select}"


def found(spark: SparkSession, sf_dir: str, only=None) -> DataFrame:
    return D.detect_all(steps(spark, sf_dir), runs(spark, sf_dir), only)


def reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s, r = steps(spark, sf_dir), runs(spark, sf_dir)
    return M.detected_reports(r, s), r, s, D.detect_all(s, r)


# ---------------------------------------------------------------- rules


def _shown(f: DataFrame) -> DataFrame:
    return f.select("run_key", "detector", "pattern", "severity", "confidence", F.col("start").alias("start_step"), F.col("end").alias("end_step"), F.col("wasted_steps").alias("wasted"))


@query("detect_all", with_(FOUND_SQL, f"SELECT {_SHOWN} FROM found"))
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(found(spark, sf_dir))


PATTERNS = {
    "never_verified": "verification_gap", "stale_verification": "verification_gap", "submitted_after_failed_verification": "submit_despite_failure", "rejected_edit_streak": "edit_error", "gold_miss": "localization_failure",
    "edit_missing_from_patch": "lost_edit", "empty_patch": "termination_anomaly", "iteration_cap": "termination_anomaly", "patch_ignores_source": "termination_anomaly", "no_submit": "termination_anomaly",
}

for _pattern, _detector in PATTERNS.items():
    query(_pattern, with_(FOUND_SQL, f"SELECT {_SHOWN} FROM found WHERE pattern = '{_pattern}'"))(lambda spark, sf_dir, p=_pattern, d=_detector: _shown(found(spark, sf_dir, [d]).filter(F.col("pattern") == p)))


@query("filter_findings", with_(FOUND_SQL, f"SELECT {_SHOWN} FROM found WHERE confidence >= 0.8 AND sev <= 1 AND detector IN ('edit_error', 'termination_anomaly')"))
def filter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(D.filter_findings(found(spark, sf_dir), 0.8, ["edit_error", "termination_anomaly"], "medium"))


# ---------------------------------------------------------------- sequences


@query("verification_steps", with_(STEPS_SQL, "SELECT run_key, idx, made AS has_script, ev AS edit_event FROM s WHERE verifies OR ev"))
def verification_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = O.with_flags(steps(spark, sf_dir))
    return f.filter("verifies OR edit_event").select("run_key", "idx", (F.size("created_scripts") > 0).alias("has_script"), "edit_event")


@query("edit_sessions", with_(STEPS_SQL, "SELECT run_key, idx FROM ses WHERE session"))
def edit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.edit_sessions(O.with_flags(steps(spark, sf_dir))).filter("session").select("run_key", "idx")


@query("dense_groups", with_(FOUND_SQL, "SELECT run_key, path, span FROM walk WHERE span IS NOT NULL"))
def dense_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = O.with_flags(steps(spark, sf_dir)).filter("rejected").groupBy("run_key", F.get("paths", F.lit(0)).alias("path")).agg(F.array_sort(F.collect_list("idx")).alias("p"))
    return f.select("run_key", "path", F.explode(O.dense_groups(F.col("p"), 3, 10)).alias("span"))


@query("open_file_pointer", with_(STEPS_SQL, "SELECT run_key, idx, last_value(CASE WHEN kind = 'edit' THEN path WHEN kind = 'read' THEN 'src/m' || k % 9 || '.py' END IGNORE NULLS) OVER (PARTITION BY run_key ORDER BY idx) AS open_file FROM s"))
def open_file_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("run_key", "idx", O.carry_forward(F.col("path")).alias("open_file"))


@query("call_answer_pairing", "SELECT c.conv_id AS run_key, c.turn AS pos, a.text AS answer FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant' WHERE c.role = 'user'")
def call_answer_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    calls = c.filter("role = 'user'").select(F.col("conv_id").alias("run_key"), F.concat(F.lit("q"), (F.col("turn") + 1).cast("string")).alias("call_id"), F.col("turn").alias("pos"))
    answers = c.filter("role = 'assistant'").select(F.col("conv_id").alias("run_key"), F.concat(F.lit("q"), F.col("turn").cast("string")).alias("call_id"), F.col("turn").alias("pos"), "text")
    return O.pair_answers(calls, answers).select("run_key", "pos", "answer")


@query("context_window", with_(FOUND_SQL, "SELECT f.run_key, pattern, a AS start_step, s.idx, list_contains(wasted, s.idx) AS is_wasted FROM found f JOIN s ON s.run_key = f.run_key AND s.idx BETWEEN a - 2 AND b + 2 WHERE detector = 'edit_error'"))
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.context(found(spark, sf_dir, ["edit_error"]), steps(spark, sf_dir), 2).select("run_key", F.col("rule").alias("pattern"), F.col("start").alias("start_step"), "idx", "is_wasted")


@query("novelty", with_(WASTE_SQL, "SELECT run_key, novel, results AS total, novel / results AS novel_observation_ratio FROM shape WHERE results > 0"))
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).select("run_key", X.observation_key("observation", "error_fp").alias("observation_key"))
    return O.novelty(s)


@query("last_steps", with_(STEPS_SQL, "SELECT run_key, idx, kind FROM (SELECT *, row_number() OVER (PARTITION BY run_key ORDER BY idx DESC) AS d FROM s) WHERE d <= 8"))
def last_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.last_steps(steps(spark, sf_dir)).select("run_key", "idx", "kind")


@query("head_and_tail", with_(STEPS_SQL, "SELECT run_key, idx FROM (SELECT run_key, idx, count(*) OVER (PARTITION BY run_key) AS n FROM s) WHERE n <= 10 OR idx < 5 OR idx >= n - 5"))
def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.head_and_tail(steps(spark, sf_dir), ["run_key"], "idx", 10).select("run_key", "idx")


# ---------------------------------------------------------------- accounting


@query("attribute_waste", with_(WASTE_SQL, "SELECT run_key, step, category FROM waste"))
def attribute_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.attribute_waste(found(spark, sf_dir))


@query("waste_report", with_(WASTE_SQL, "SELECT run_key, resolved, total_steps, wasted_steps, wasted_step_ratio, n_findings, source_edits, test_runs, tests_per_source_edit, test_run_ratio, novel_observation_ratio FROM rep"))
def waste_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir)[0].select("run_key", "resolved", *M.PREDICTORS[:3], "n_findings", *M.PREDICTORS[4:])


@query("waste_by_phase", with_(WASTE_SQL, "SELECT run_key, CASE category WHEN 'localization_failure' THEN 'planning' WHEN 'submit_despite_failure' THEN 'verification' WHEN 'verification_gap' THEN 'verification' ELSE 'execution' END AS phase, count(*) AS n FROM waste GROUP BY ALL"))
def waste_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir)[0].select("run_key", F.explode("by_phase").alias("phase", "n"))


@query("findings_by_severity", with_(WASTE_SQL, "SELECT run_key, severity, count(*) AS n FROM found GROUP BY ALL"))
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir)[0].select("run_key", F.explode("by_severity").alias("severity", "n"))


_MEANS = ", ".join(f"round(avg({c}), 9) AS {m}" for m, c in M.MEANS.items())


@query("outcome_stats", with_(WASTE_SQL, f"SELECT label, count(*) AS n, {_MEANS} FROM rep JOIN lab USING (run_key) GROUP BY label UNION ALL SELECT 'all', count(*), {_MEANS} FROM rep"))
def outcome_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.outcome_stats(reports(spark, sf_dir)[0]).withColumns({m: F.round(m, 9) for m in M.MEANS})


@query("category_stats", with_(WASTE_SQL, """, l2 AS (SELECT run_key, label FROM lab UNION ALL SELECT run_key, 'all' FROM lab), w AS (SELECT run_key, category, count(*) AS n FROM waste GROUP BY ALL)
SELECT label, category, round(count(*) / any_value(nn), 9) AS category_rate, round(sum(coalesce(w.n, 0)) / any_value(nn), 9) AS mean_waste FROM hits JOIN l2 USING (run_key) JOIN (SELECT label, count(*) AS nn FROM l2 GROUP BY label) USING (label) LEFT JOIN w USING (run_key, category) GROUP BY label, category"""))
def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.category_stats(reports(spark, sf_dir)[0]).withColumns({c: F.round(c, 9) for c in ("category_rate", "mean_waste")})


@query("category_lift", with_(WASTE_SQL, """SELECT category, round(count(*) FILTER (WHERE label = 'unresolved') / any_value(nu) - count(*) FILTER (WHERE label = 'resolved') / any_value(nr), 9) AS lift FROM hits JOIN lab USING (run_key),
(SELECT count(*) FILTER (WHERE label = 'unresolved') AS nu, count(*) FILTER (WHERE label = 'resolved') AS nr FROM lab) WHERE label <> 'unknown' GROUP BY category"""))
def category_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.category_lift(reports(spark, sf_dir)[0]).select("category", F.round("lift", 9).alias("lift"))


@query("kind_mix", with_(STEPS_SQL, "SELECT kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 9) AS share FROM s GROUP BY kind"))
def kind_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kind_mix(steps(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query("kinds_per_run", with_(STEPS_SQL, "SELECT run_key, kind, count(*) AS n FROM s GROUP BY ALL"))
def kinds_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kind_mix(steps(spark, sf_dir), ["run_key"]).select("run_key", "kind", "n")


_AUC = "SELECT '{0}' AS predictor, round(coalesce((sum(CASE WHEN resolved THEN 0 ELSE rk END) - p * (p + 1) / 2) / (p * (count(*) - p)), CAST('nan' AS DOUBLE)), 9) AS auc FROM (SELECT resolved, rank() OVER (ORDER BY {1}) + (count(*) OVER (PARTITION BY {1}) - 1) / 2 AS rk, count(*) FILTER (WHERE NOT resolved) OVER () AS p FROM per WHERE resolved IS NOT NULL) GROUP BY p"


_CHARGED = ["edit_error", "localization_failure", "lost_edit", "termination_anomaly"]
_AUC_ROWS = ", per AS (SELECT rep.*, " + ", ".join(f"(SELECT count(*) FROM waste w WHERE w.run_key = rep.run_key AND w.category = '{c}') AS \"wasted_steps:{c}\"" for c in _CHARGED) + " FROM rep) "


@query("auc", with_(WASTE_SQL + _AUC_ROWS, " UNION ALL ".join([*(_AUC.format(p, p) for p in M.PREDICTORS), *(f"SELECT * FROM ({_AUC.format(f'wasted_steps:{c}', _q)}) WHERE EXISTS (SELECT 1 FROM waste JOIN rep r USING (run_key) WHERE category = '{c}' AND r.resolved IS NOT NULL)" for c in _CHARGED for _q in [f'"wasted_steps:{c}"'])])))
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.discrimination(reports(spark, sf_dir)[0]).withColumn("auc", F.round("auc", 9))


@query("top_quantile_failures", with_(WASTE_SQL, """, r AS (SELECT *, row_number() OVER (ORDER BY wasted_step_ratio DESC, sha256(run_key), run_key) AS nth, count(*) OVER () AS n FROM rep WHERE resolved IS NOT NULL)
SELECT CAST(q AS DOUBLE) AS share, count(*) AS k, round(avg(CASE WHEN resolved THEN 0 ELSE 1 END), 9) AS failed_rate FROM r, (VALUES (0.10), (0.25), (0.50), (0.75), (1.00)) x(q) WHERE nth <= greatest(1, floor(n * CAST(q AS DOUBLE))) GROUP BY q"""))
def top_quantile_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_failures(reports(spark, sf_dir)[0]).withColumn("failed_rate", F.round("failed_rate", 9))


@query("detector_profile", with_(WASTE_SQL, """, x AS (SELECT detector, pattern, run_key, count(*) AS n, sum(len(wasted)) AS w FROM found GROUP BY ALL), nn AS (SELECT count(*) FILTER (WHERE label = 'resolved') AS nr, count(*) FILTER (WHERE label = 'unresolved') AS nu FROM lab)
SELECT detector, pattern, round(count(*) FILTER (WHERE label = 'resolved') / any_value(nr), 9) AS resolved_rate, round(count(*) FILTER (WHERE label = 'unresolved') / any_value(nu), 9) AS unresolved_rate, CAST(sum(n) AS BIGINT) AS findings,
round(coalesce(sum(w) FILTER (WHERE label = 'unresolved'), 0) / any_value(nu), 9) AS waste_per_unresolved FROM x JOIN lab USING (run_key), nn GROUP BY detector, pattern"""))
def detector_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r, _, f = reports(spark, sf_dir)
    return M.detector_profile(r, f).drop("lift").withColumns({c: F.round(c, 9) for c in ("resolved_rate", "unresolved_rate", "waste_per_unresolved")})


@query("cross_framework", with_(WASTE_SQL, """SELECT framework, count(*) AS runs, CAST(sum(total_steps) AS BIGINT) AS steps, round(sum(total_steps) / count(*), 9) AS mean_steps, CAST(0 AS BIGINT) AS unmapped, round(sum(source_edits) / count(*), 9) AS mean_source_edits, round(sum(test_runs) / count(*), 9) AS mean_test_runs,
round(sum(test_runs) / greatest(1, sum(source_edits)), 9) AS tests_per_edit, round(sum(wasted_steps) / greatest(1, sum(total_steps)), 9) AS wasted_step_ratio, round(sum(n_findings) / count(*), 9) AS findings_per_run FROM rep GROUP BY framework"""))
def cross_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep, _, s, _ = reports(spark, sf_dir)
    return M.cross_framework(rep, s).withColumns({c: F.round(c, 9) for c in ("mean_steps", "mean_source_edits", "mean_test_runs", "tests_per_edit", "wasted_step_ratio", "findings_per_run")})


@query("pool_totals", with_(WASTE_SQL, """SELECT (SELECT count(*) FROM rep) AS records, (SELECT count(DISTINCT CASE WHEN u % 7 = 0 THEN 'acme/' || u % 3 ELSE 'acme__lib' END) FROM rep) AS distinct_repos, (SELECT count(*) FROM lab WHERE label = 'resolved') AS resolved, (SELECT count(*) FROM lab WHERE label = 'unresolved') AS unresolved,
(SELECT count(*) FROM lab WHERE label = 'unknown') AS unknown, (SELECT count(*) FROM s) AS steps, (SELECT count(*) FROM s WHERE bad) AS failed_steps, (SELECT count(*) FROM s WHERE kind = 'shell' AND k % 5 = 2) AS nonzero_exits, (SELECT count(*) FROM s WHERE bad) AS error_kinds, CAST(0 AS BIGINT) AS empty_observations,
(SELECT count(*) FROM found) AS findings, (SELECT count(*) FROM waste) AS wasted_steps"""))
def pool_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r, s, f = reports(spark, sf_dir)
    return M.pool_totals(r, s, f)


@query("findings_by_detector", with_(FOUND_SQL, "SELECT run_key, detector, count(*) AS n FROM found GROUP BY ALL"))
def findings_by_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.findings_by_detector(found(spark, sf_dir)).select("run_key", F.explode("by_detector").alias("detector", "n"))


@query("gold_coverage", "SELECT count(*) AS trajectories, count(*) FILTER (WHERE u % 3 <> 0) AS attached, count(*) FILTER (WHERE u % 3 <> 0) / count(*) AS ratio FROM (SELECT DISTINCT user_id AS u FROM events)")
def gold_coverage_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_coverage(runs(spark, sf_dir))


@query("export_csv", with_(WASTE_SQL, """SELECT 'acme__lib-' || u AS instance_id, framework, resolved, total_steps, source_edits, test_runs, wasted_steps, n_findings, (SELECT count(*) FROM waste w WHERE w.run_key = rep.run_key AND category = 'edit_error') AS edit_error FROM rep"""))
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelog.sources.sinks import csv_rows

    rows = csv_rows(reports(spark, sf_dir)[0])
    return rows.select("instance_id", "framework", "resolved", "total_steps", "source_edits", "test_runs", "wasted_steps", "n_findings", F.coalesce("edit_error", F.lit(0)).cast("long").alias("edit_error"))


# ---------------------------------------------------------------- sources


@query("message_stream", """
WITH c AS (SELECT conv_id, turn, role, text, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS nu FROM conversations WHERE role IN ('user', 'assistant')),
d AS (SELECT * FROM c WHERE NOT (role = 'user' AND nu = 1)), f AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT CAST(conv_id AS VARCHAR) AS run_key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS idx, 'thought' AS kind, nullif(text, '') AS thought, CASE WHEN nr = 'user' THEN nt END AS observation FROM f WHERE role = 'assistant'""")
def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps_of(_conversation_runs(spark, sf_dir)).select("run_key", "idx", "kind", "thought", "observation")


def _conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    m = F.struct("turn", F.when(F.col("role") == "assistant", "ai").otherwise(F.col("role")).alias("role"), "text")
    rec = c.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(m)).alias("trajectory"), F.first("conv_id").cast("string").alias("instance_id"))).alias("record"))
    return parsed(from_table(rec, "record", "conv_id"))


@query("message_runs", """SELECT CAST(conv_id AS VARCHAR) AS instance_id, 'sweagent' AS framework, arg_min(text, turn) FILTER (WHERE role = 'user') AS problem_statement FROM conversations GROUP BY conv_id""")
def message_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversation_runs(spark, sf_dir).select("instance_id", "framework", "problem_statement")


@query("class_quota", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events) WHERE nth <= 25")
def class_quota_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_quota(table(spark, sf_dir, "events"), "event_type", "event_id", 25).select("user_id", "event_id")


# ---------------------------------------------------------------- draws

_DRAW = "sha256('7|' || {0})"


@query("capped_sample", f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY {_DRAW.format('event_id')}, event_id) AS nth FROM events) WHERE nth <= 20")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.capped(table(spark, sf_dir, "events"), ["event_type"], ["event_id"], 20, 7).select("event_id")


@query("uniform_sample", f"SELECT event_id FROM events ORDER BY {_DRAW.format('event_id')}, event_id LIMIT 50")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.uniform(table(spark, sf_dir, "events"), ["event_id"], 50, 7).select("event_id")


@query("stratified_sample", with_(STEPS_SQL, f"""SELECT run_key, stratum FROM (SELECT run_key, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_DRAW.format('run_key')}, run_key) AS nth FROM (
SELECT run_key, CASE WHEN any_value(u) % 11 = 0 THEN 'unknown' WHEN any_value(u) % 2 = 0 THEN 'resolved' ELSE 'unresolved' END || '/' || CASE WHEN count(*) < 40 THEN 'short' WHEN count(*) < 120 THEN 'medium' ELSE 'long' END AS stratum FROM s GROUP BY run_key)) WHERE nth <= 5"""))
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("run_key")).agg(F.count("*").alias("n"))
    return L.stratified(runs(spark, sf_dir).join(n, "run_key"), M.outcome(), F.col("n"), ["run_key"], 5, 7).select("run_key", "stratum")


@query("recall_candidates", with_(FOUND_SQL, "SELECT run_key FROM t WHERE u % 11 <> 0 AND u % 2 = 1 AND run_key NOT IN (SELECT run_key FROM found WHERE detector IN ('edit_error', 'termination_anomaly'))"))
def recall_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.recall_candidates(runs(spark, sf_dir), found(spark, sf_dir, ["edit_error", "termination_anomaly"])).select("run_key")


# ---------------------------------------------------------------- evaluation

LIVE_SQL = """live AS (SELECT doc_id, source AS detector, (n_chars % 100) / 100 AS confidence FROM documents WHERE doc_id % 10 <> 0),
lab AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'uncertain' WHEN quality = 1 THEN 'valid' ELSE 'invalid' END AS verdict, 'r' || doc_id % 4 AS reason FROM labels),
j AS (SELECT * FROM live JOIN lab USING (doc_id))"""


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents").filter("doc_id % 10 <> 0"), F.col("doc_id").cast("string")
    return d.select(F.concat(F.lit("v2|run|"), "source", F.lit("|"), i).alias("finding_id"), i.alias("finding_signature"), F.concat(F.lit("i|"), "source", F.lit("|"), i).alias("legacy_finding_id"), F.col("source").alias("detector"), ((F.col("n_chars") % 100) / 100).alias("confidence"))


def _labels(spark: SparkSession, sf_dir: str, old: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    i = F.col("doc_id").cast("string")
    fid = F.concat(F.lit("i|" if old else "v2|run|"), "source", F.lit("|"), i)
    verdict = F.when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "valid").otherwise("invalid")
    return d.select(fid.alias("finding_id"), verdict.alias("verdict"), F.concat(F.lit("r"), (F.col("doc_id") % 4).cast("string")).alias("reason"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.joined(V.match_labels(_live(spark, sf_dir), _labels(spark, sf_dir)))


@query("label_join", with_(LIVE_SQL, "SELECT 'v2|run|' || detector || '|' || doc_id AS finding_id, detector, confidence, verdict, reason FROM j"))
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("finding_id", "detector", "confidence", "verdict", "reason")


@query("legacy_label_join", with_(LIVE_SQL, "SELECT 'v2|run|' || detector || '|' || doc_id AS finding_id, verdict FROM j"))
def legacy_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.match_labels(_live(spark, sf_dir), _labels(spark, sf_dir, True), allow_legacy=True).filter("state = 'legacy_matched'").select("finding_id", "verdict")


@query("stale_labels", "SELECT source AS detector, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE doc_id % 10 = 0 GROUP BY source")
def stale_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.stale_labels(V.match_labels(_live(spark, sf_dir), _labels(spark, sf_dir)))


@query("label_coverage", with_(LIVE_SQL, "SELECT (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS labels, (SELECT count(*) FROM j) AS matched, (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE doc_id % 10 = 0) AS stale, CAST(0 AS BIGINT) AS legacy_matched, CAST(0 AS BIGINT) AS rejected_legacy, (SELECT count(*) FROM live) AS live, CAST(0 AS BIGINT) AS duplicate_ids, (SELECT count(*) FROM live) - (SELECT count(*) FROM j) AS unlabelled"))
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _live(spark, sf_dir)
    return V.coverage(live, V.match_labels(live, _labels(spark, sf_dir)))


_TALLY = "count(*) FILTER (WHERE verdict = 'valid') AS valid, count(*) FILTER (WHERE verdict = 'invalid') AS invalid, count(*) FILTER (WHERE verdict <> 'uncertain') AS n, coalesce(count(*) FILTER (WHERE verdict = 'valid') / nullif(count(*) FILTER (WHERE verdict <> 'uncertain'), 0), CAST('nan' AS DOUBLE)) AS precision"


@query("precision_by_detector", with_(LIVE_SQL, f"SELECT detector, {_TALLY} FROM j GROUP BY detector UNION ALL SELECT 'silent_rule', 0, 0, 0, CAST('nan' AS DOUBLE)"))
def precision_by_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.precision_by_detector(_matched(spark, sf_dir), ["silent_rule"])


@query("confidence_bands", with_(LIVE_SQL, f"SELECT CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, {_TALLY} FROM j JOIN (VALUES (0.0, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.01)) b(lo, hi) ON confidence >= CAST(lo AS DOUBLE) AND confidence < CAST(hi AS DOUBLE) GROUP BY lo, hi HAVING count(*) FILTER (WHERE verdict <> 'uncertain') > 0"))
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.confidence_bands(_matched(spark, sf_dir))


@query("threshold_curve", with_(LIVE_SQL, """, g AS (SELECT CAST(c AS DOUBLE) AS threshold, count(*) FILTER (WHERE verdict = 'valid') AS valid, count(*) FILTER (WHERE verdict = 'invalid') AS invalid FROM j JOIN (VALUES (0.0), (0.5), (0.6), (0.65), (0.7), (0.75), (0.8), (0.85), (0.9), (0.95)) x(c) ON confidence >= CAST(c AS DOUBLE) GROUP BY c),
h AS (SELECT threshold, valid + invalid AS kept, valid, invalid, valid / (valid + invalid) AS precision, valid / (SELECT count(*) FROM j WHERE verdict = 'valid') AS retained FROM g WHERE valid + invalid > 0)
SELECT threshold, kept, valid, invalid, round(precision, 9) AS precision, round(retained, 9) AS retained, coalesce(threshold = (SELECT min(threshold) FROM h WHERE precision >= 0.6), false) AS meets FROM h"""))
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.threshold_curve(_matched(spark, sf_dir), 0.6).withColumns({c: F.round(c, 9) for c in ("precision", "retained")})


@query("top_reasons", with_(LIVE_SQL, "SELECT reason, count(*) AS n FROM j WHERE verdict = 'invalid' GROUP BY reason ORDER BY n DESC, reason LIMIT 10"))
def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_reasons(_matched(spark, sf_dir))


@query("regression_gate", with_(LIVE_SQL, f""", p AS (SELECT detector, {_TALLY} FROM j GROUP BY detector), l AS (SELECT detector, count(*) AS live_n FROM live GROUP BY detector)
SELECT detector, n, precision, n / live_n AS coverage, list_filter([CASE WHEN n = 0 THEN 'no_sample' END, CASE WHEN n > 0 AND n < 20 THEN 'few_labels' END, CASE WHEN n > 0 AND n / live_n < 0.8 THEN 'low_coverage' END, CASE WHEN n > 0 AND precision < 0.6 THEN 'low_precision' END], lambda x: x IS NOT NULL) AS problems FROM p JOIN l USING (detector)"""))
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, core = _live(spark, sf_dir), [r.source for r in table(spark, sf_dir, "documents").select("source").distinct().collect()]
    m = V.match_labels(live, _labels(spark, sf_dir))
    named = {r.detector for r in V.joined(m).select("detector").distinct().collect()}
    return V.regression_gate(live, V.joined(m), [c for c in core if c in named], target=0.6)


# ---------------------------------------------------------------- scalar functions on vectors


def vectors(name: str, cases: list[tuple[str | None, object]], f: Callable[[Column], Column], kind: str) -> None:
    """A query that gives each event the case of its number, and SQL that states what must come out."""

    def sql(v: object) -> str:
        if v is None:
            return f"CAST(NULL AS {kind})"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(sql, v)) + "]"
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    whens = " ".join(f"WHEN {k} THEN {sql(v)}" for k, (_, v) in enumerate(cases))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events").select("event_id", F.get(F.array(*(F.lit(c).cast("string") for c, _ in cases)), (F.col("event_id") % len(cases)).cast("int")).alias("x"))
        return e.select("event_id", f(F.col("x")).alias("y"))

    query(name, f"SELECT event_id, CAST(CASE event_id % {len(cases)} {whens} END AS {kind}) AS y FROM events")(run)


vectors("repo_relative", [("/testbed/src/a.py", "src/a.py"), ("/workspace/acme__lib/src/a.py", "src/a.py"), ("./././b.py", "b.py"), ("'src/a.py'", "src/a.py"), ("src\\a.py", "src/a.py"), ("lib/testbed/a.py", "lib/testbed/a.py"), (None, ""), ("/usr/lib/x.py", "usr/lib/x.py"), ("/repo/app/code/project/z.py", "project/z.py")], X.repo_relative, "VARCHAR")
vectors("norm_ws", [("  a\t\n b ", "a b"), ("", ""), ("x", "x"), ("é  ü", "é ü")], X.norm_ws, "VARCHAR")
vectors("clean_output", [("\x1b[31mred\x1b[0m", "red"), ("a\r\nb", "a\nb"), ("10%\r50%\rdone\nok", "done\nok"), (None, "")], X.clean_output, "VARCHAR")
vectors("strip_volatile", [("cat /tmp/ab1/x.log", "cat /tmp/<TMP>"), ("cd /home/me/src", "cd /<HOME>/src"), ("git show deadbeef12", "git show <HEX>"), ("at 2024-01-02T03:04:05Z", "at <TS>"), ("kill pid=77", "kill pid=<N>"), ("v 1.2.3 and 42 and 7", "v <VER> and <N> and 7")], X.strip_volatile, "VARCHAR")
vectors("split_segments", [("a; b | c && d", ["a", " b ", " c ", " d"]), ("echo 'x;y' | z", ["echo 'x;y' ", " z"]), ('grep "a\\|b" f', ['grep "a\\|b" f']), (None, [""]), ("tox;", ["tox", ""])], X.split_segments, "VARCHAR[]")
vectors("compact", [("a\n\n\n\n   b   c", "a\n b c"), ("short", "short"), ("0123456789" * 4, "01234567890123456789\n… [10 chars elided] …\n0123456789")], lambda c: X.compact(c, 30), "VARCHAR")
vectors("signature", [("at 0xdeadbeef", "at 0xADDR"), ("No file '/a/b/c.txt'", "No file 'c.txt'"), ("x.py:12:3 bad", "x.py:N bad"), ("line 88 of 12345", "line N of N"), ("took 1.5s v1.2", "took Ns v1.2")], X.normalize_signature, "VARCHAR")
vectors("edit_region", [("a  b\n c", "a b c"), ("", None), (None, None)], X.edit_region, "VARCHAR")
vectors("is_test_command", [("pytest -q", True), ("cat tests/test_a.py", False), ("cd x && python -m pytest", True), ("tox -e py", True), ("pytest --help", False), ("grep 'pytest' a | wc -l", False), ("python -c 'import a'", True), ("make test", True), ("npm run test", True), ("pytest --collect-only", False), (None, False), ("python -m django.runtests", True)], P.is_test_command, "BOOLEAN")
vectors("install_setup_revert", [("pip install x", "110"), ("git clone u", "010"), ("git stash", "011"), ("git checkout a", "001"), ("apt-get install -y g", "110"), ("ls", "000"), ("source venv/bin/activate", "010"), ("conda create -n a", "010")], lambda c: F.concat(P.is_install_command(c).cast("int").cast("string"), P.is_setup_command(c).cast("int").cast("string"), P.is_revert_command(c).cast("int").cast("string")), "VARCHAR")
vectors("path_classes", [("tests/a.py", "1010"), ("src/test_b.py", "1010"), ("repro_x.py", "0110"), ("checker.py", "0000"), ("check_a.sh", "0110"), ("README.md", "0001"), ("setup.cfg", "0001"), ("src/a.py", "0000"), ("pkg/conftest.py", "1011"), (None, "0000")], lambda c: F.concat(*(p(c).cast("int").cast("string") for p in (P.is_test_tree_file, P.is_scratch_named, P.is_test_or_scratch, P.is_doc_or_config))), "VARCHAR")
vectors("edit_was_rejected", [("ERROR: x", True), ("  No replacement was performed, y", True), ("ok\nerror: later", False), (None, False), ("Your edit was not applied", True)], P.edit_was_rejected, "BOOLEAN")
vectors("invoked_scripts", [("python a.py", ["a.py"]), ("./run.sh && node b.js x", ["./run.sh", "b.js"]), ("cat a.py", []), ("python 'c d.py'", []), ("bash x.sh; bash x.sh", ["x.sh"])], P.invoked_scripts, "VARCHAR[]")
vectors("exit_code", [("ok\n[exit code: 0]", 0), ("bad\nExit code: 2\n", 2), ("Process exited with code 127", 127), ("[The command completed with exit code 1.]", 1), ("said exit code 3 then went on", 3), ("none", None), ("x exit code 5\ny\n[exit code: 4]", 4)], exit_code, "INTEGER")
vectors("observation_key", [("", "empty"), (" \n", "empty"), ("abc", "ok:3:ba7816bf8f01cfea"), (None, "empty")], lambda c: X.observation_key(c), "VARCHAR")

_ERRORS = [
    ("Traceback (most recent call last):\n  File \"a.py\", line 3\nValueError: bad 0x1f", "value_error", "value_error:ValueError: bad 0xADDR"), ("ModuleNotFoundError: No module named 'x'", "import_error", "import_error:ModuleNotFoundError: No module named 'x'"),
    ("bash: foo: command not found", "command_not_found", "command_not_found:bash: foo: command not found"), ("fine", None, None), ("ValueError: x\n[exit code: 0]", None, None), ("undefined reference to `f'", None, None),
    ("FAILED tests/test_a.py::test_x - assert 1", "test_failure", "test_failure:FAILED tests/test_a.py::test_x - assert 1"), ("error", None, None), ("E   assert 1 == 2", "assertion_error", "assertion_error:assert 1 == 2"), ("fatal: not a git repository", "git_error", "git_error:fatal: not a git repository"),
]


def _sql_case(k: int) -> str:
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE event_id % {len(_ERRORS)} " + " ".join(f"WHEN {i} THEN {show(e[k])}" for i, e in enumerate(_ERRORS)) + " END"


@query("classify_error", f"SELECT event_id, {_sql_case(1)} AS error_kind, {_sql_case(2)} AS error_fp FROM events")
def classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.get(F.array(*(F.lit(x[0]) for x in _ERRORS)), (F.col("event_id") % len(_ERRORS)).cast("int")).alias("x"))
    return with_errors(e, "x").select("event_id", "error_kind", "error_fp")


@query("action_key", with_(STEPS_SQL, """SELECT run_key, idx, CASE kind WHEN 'shell' THEN 'shell:' || CASE k % 8 WHEN 0 THEN 'pytest -q' WHEN 1 THEN 'python probe.py' WHEN 2 THEN 'git checkout src/util.py' WHEN 3 THEN 'ls -la src' WHEN 4 THEN 'pip install x' WHEN 5 THEN 'cat a | grep "b;c"; tox' WHEN 6 THEN 'python -m unittest --help' ELSE 'cd /repo && make test' END
WHEN 'read' THEN 'read:src/m' || k % 9 || '.py' WHEN 'edit' THEN 'edit:' || CASE WHEN event_id % 7 = 0 THEN 'create' ELSE 'str_replace' END || ':' || path WHEN 'search' THEN 'search:find ' || k || ':' ELSE 'submit' END AS action_key FROM s"""))
def action_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("run_key", "idx", X.action_key().alias("action_key"))


@query("short_hash", "SELECT page_id, left(sha256(url), 12) AS h FROM pages")
def short_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.short_hash("url").alias("h"))


@query("document_keys", "SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10)) = '' THEN 'empty' ELSE 'ok:' || length(text) || ':' || left(sha256(text), 16) END AS k, left(sha256(left(text, 400)), 16) AS d FROM documents WHERE text NOT LIKE '%' || chr(13) || '%' AND text NOT LIKE '%' || chr(27) || '%'")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(~F.contains("text", F.lit("\r")) & ~F.contains("text", F.lit("\x1b")))
    return d.select("doc_id", X.observation_key("text").alias("k"), X.observation_digest("text").alias("d"))


# ---------------------------------------------------------------- without SQL


@query("patch_files")
def patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelog.functions.diff import patch_files as files

    return runs(spark, sf_dir).select("run_key", files(F.col("model_patch")).alias("files"))


@query("finding_identity")
def finding_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelog.operators.identity import distinct_findings, run_ids, with_identity

    s, r = steps(spark, sf_dir), runs(spark, sf_dir)
    s = s.withColumns({c: F.lit(None).cast("string") for c in ("state", "meta")})
    once, _ = distinct_findings(with_identity(D.detect_all(s, r), run_ids(r.withColumn("upstream_id", F.lit(None).cast("string")), s)))
    return once.select("finding_id", "legacy_finding_id", "run_key")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: steps to findings to attributed waste to outcome statistics."""
    return M.outcome_stats(reports(spark, sf_dir)[0])
