"""Order-aware building blocks over ``steps``: created files, verification, edit sessions, dense groups, context.

Every window is partitioned by ``run_key`` and ordered by ``idx``, so all of them share one exchange; a run's length bounds what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stridelog.functions import predicates as P
from stridelog.functions.text import edit_region, repo_relative, settled


def by_run() -> WindowSpec:
    return Window.partitionBy("run_key")


def so_far(upto: int = Window.currentRow) -> WindowSpec:
    return by_run().orderBy("idx").rowsBetween(Window.unboundedPreceding, upto)


def touched(files: str = "files_touched", path: str = "path") -> Column:
    """A step's files, or its path where it lists none."""
    own = F.when(F.coalesce(F.length(path), F.lit(0)) > 0, F.array(path))
    return F.coalesce(F.when(F.size(files) > 0, F.col(files)), own, F.array().cast("array<string>"))


def with_flags(steps: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """The narrow frame that all rules read: texts are judged here once and then left behind. ``more``: further columns over ``steps`` that it is to have."""
    kept = ["run_key", "idx", "kind", "verb", "is_test_run", "error_kind", "error_fp", "exit_code"]
    obs = F.regexp_replace(F.coalesce("observation", F.lit("")), r"\A\s+", "")
    edit = F.col("kind") == "edit"
    narrow = steps.select(
        *kept,
        touched().alias("files"),
        settled(edit & P.edit_was_rejected("observation")).alias("rejected"),
        (edit & ((F.coalesce("verb", F.lit("")) == "create") | F.startswith(obs, F.lit("File created successfully")))).alias("creates"),
        edit_region("old_str").alias("region"),
        F.when(F.col("kind") == "shell", F.transform(P.invoked_scripts("command"), repo_relative)).alias("invoked"),
        ((F.col("kind") == "shell") & P.is_revert_command("command")).alias("reverts"),
        *(c.alias(name) for name, c in (more or {}).items()),
    )
    narrow = narrow.withColumn("creates", F.col("creates") & ~F.col("rejected")).withColumn("paths", settled(F.filter(F.transform("files", repo_relative), lambda p: p != ""))).withColumn("landed", (F.col("kind") == "edit") & ~F.col("rejected"))
    of_run = lambda what: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("creates"), what)).over(by_run())))
    out = narrow.withColumns({"created_files": of_run(F.col("paths")), "created_scripts": of_run(F.filter("paths", P.is_script))})
    out = out.withColumn("verifies", F.coalesce("is_test_run", F.lit(False)) | F.coalesce(F.arrays_overlap("invoked", "created_scripts"), F.lit(False)))
    aside = F.forall("files", lambda f: P.is_test_or_scratch(f) | P.is_doc_or_config(f) | F.array_contains(F.col("created_scripts"), repo_relative(f)))
    return out.withColumn("edit_event", F.col("landed") & ~((F.size("files") > 0) & aside))


def edit_sessions(flags: DataFrame) -> DataFrame:
    """``flags`` with ``session``: the first event of unverified work on one region of one set of files."""
    checks = F.sum(F.col("verifies").cast("int")).over(so_far())
    mark = F.struct(F.array_sort(F.array_distinct("files")).alias("f"), F.col("region").alias("r"), checks.alias("v"))
    # an edit is no verification, so equal running counts mean that none lies between
    out = flags.withColumn("_mark", F.when(F.col("edit_event"), mark))
    last = F.last("_mark", ignorenulls=True).over(so_far(-1))
    return out.withColumn("session", F.col("edit_event") & ~F.coalesce(F.col("_mark").eqNullSafe(last), F.lit(False))).drop("_mark")


def dense_groups(positions: Column, threshold: int, window: int) -> Column:
    """Of sorted positions the groups, taken greedily from the left, of at least ``threshold`` less than ``window`` from their first."""
    none = F.expr("cast(array() as array<array<int>>)")
    start = F.struct(none.alias("out"), F.expr("cast(array() as array<int>)").alias("open"))
    emitted = lambda a: F.when(F.size(a["open"]) >= threshold, F.array_append(a["out"], a["open"])).otherwise(a["out"])

    def step(a: Column, p: Column) -> Column:
        # `open` begins at the first place that may still begin a group; once p is too far from it the group is complete or that place is given up
        fits = (F.size(a["open"]) == 0) | (p - F.get(a["open"], F.lit(0)) < window)
        rest = F.when(fits, a["open"]).when(F.size(a["open"]) >= threshold, F.expr("cast(array() as array<int>)")).otherwise(F.filter(a["open"], lambda x: p - x < window))
        return F.struct(F.when(fits, a["out"]).otherwise(emitted(a)).alias("out"), F.array_append(rest, p).alias("open"))

    return F.coalesce(F.aggregate(positions, start, step, emitted), none)


def carry_forward(value: Column) -> Column:
    """The last value that was given, this row's included: an editor's open file."""
    return F.last(F.nullif(value, F.lit("")), ignorenulls=True).over(so_far())


def pair_answers(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """calls (run_key, call_id, pos, ...) with the text of their answer.

    An answer goes to the latest earlier call of its id; of several answers to a call the latest counts.
    """
    a = answers.select(F.col("run_key").alias("_r"), F.col("call_id").alias("_i"), F.col("pos").alias("_at"), F.col("text").alias("_text"))
    met = calls.filter("call_id <> ''").select("run_key", "call_id", "pos").join(a, (F.col("run_key") == F.col("_r")) & (F.col("call_id") == F.col("_i")) & (F.col("pos") < F.col("_at")))
    to = met.groupBy("run_key", "call_id", "_at").agg(F.max("pos").alias("pos"), F.first("_text").alias("_text"))
    last = to.groupBy("run_key", "call_id", "pos").agg(F.max_by("_text", "_at").alias("answer"))
    return calls.join(last, ["run_key", "call_id", "pos"], "left")


def context(findings: DataFrame, steps: DataFrame, around: int) -> DataFrame:
    """Steps from ``around`` before a finding to ``around`` after it, with the finding's detector, rule and span: an equi-join by run with a range inside it."""
    f = findings.select(F.col("run_key").alias("_r"), "detector", F.col("pattern").alias("rule"), "start", "end", "wasted_steps")
    near = steps.join(f, (F.col("run_key") == F.col("_r")) & F.col("idx").between(F.col("start") - around, F.col("end") + around)).drop("_r")
    return near.withColumn("is_wasted", F.array_contains("wasted_steps", F.col("idx"))).drop("wasted_steps")


def novelty(keys: DataFrame, key: str = "observation_key") -> DataFrame:
    """run_key, novel, total, ratio of results that are not empty: how many differ from all before."""
    out = keys.filter(F.col(key) != "empty").groupBy("run_key").agg(F.count_distinct(key).alias("novel"), F.count("*").alias("total"))
    return out.withColumn("novel_observation_ratio", F.col("novel") / F.col("total"))
