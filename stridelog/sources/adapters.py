"""Run logs of several frameworks -> the normalized ``runs`` and ``steps``.

A record is recognised by what it holds and turned into steps inside its own row: messages become an array of events, answers are found
by call id, the editor's open file is the last one named before, and only then is the array exploded. So parsing never shuffles and takes batch and streaming tables
alike. What a step is follows from its tool or its command line, as column expressions over the exploded rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelog.functions import predicates as P
from stridelog.functions.errors import with_errors
from stridelog.functions.text import clean_output, repo_relative, settled, strip
from stridelog.schema import ERROR_BEARING

from .gold import attach_gold, load_gold
from .records import read_records

_CALL = "struct<id:string,function:struct<name:string,arguments:string>>"
MESSAGE = (
    "role string, content string, text string, action string, thought string, response string, observation string, state string, message_type string, "
    f"tool_calls array<{_CALL}>, tool_call_id string, tool_call_ids array<string>"
)
_INFO = "instance_id string, repo string, exit_status string, resolved string, model_patch string, model_name string"
HEAD = (
    "trajectory array<string>, history array<string>, instance_id string, trajectory_id string, repo string, resolved string, target string, exit_status string, model_patch string, generated_patch string, "
    f"problem_statement string, environment string, model_name string, gen_tests_correct string, pred_passes_gen_tests string, info struct<{', '.join(x.replace(' ', ':') for x in _INFO.split(', '))}>"
)
_ARGS = "command string, cmd string, thought string, message string, path string, file_name string, old_str string, new_str string, search string, replace string, text string, file_text string, search_term string, pattern string, query string"
EVENT = "struct<at:int,step:boolean,id:string,tool:string,args:string,thought:string,action:string,state:string,hint:string,observation:string>"
_NONE = f"cast(array() as array<{EVENT}>)"

#: Tools of the call-based frameworks and the kinds of steps that they are: fixed values.
TOOLS_A = {"execute_bash": "shell", "think": "thought", "finish": "submit", "task_tracker": "plan", "str_replace_editor": "edit"}
TOOLS_B = {
    "bash": "shell", "create": "edit", "create_file": "edit", "edit": "edit", "execute_bash": "shell", "find_file": "search", "finish": "submit", "insert": "edit", "open": "read", "open_file": "read",
    "run": "shell", "search": "search", "search_dir": "search", "search_file": "search", "str_replace": "edit", "submit": "submit", "undo_edit": "edit",
}

# command lines of the editor language
_OPEN, _CREATE, _EDIT = r"(?Ud)^open\s+(\S+)(?:\s+(\d+))?\s*$", r"(?Ud)^create\s+(\S+)\s*$", r"(?Ud)^edit\s*(\d+:\d+)?\s*$"
_MOVE, _FIND = r"(?Ud)^(?:goto\s+\d+|scroll_(?:down|up))\s*$", r"(?Ud)^find_file\s+(.+?)(?:\s+(\S+))?\s*$"
_SEARCH = r"""(?Ud)^search(?:_dir|_file)?\s+(".*?"|'.*?'|\S+)(?:\s+(\S+))?\s*$"""
_SUBMIT = r"(?Ud)^(?:submit|exit|exit_error|exit_cost|exit_api|exit_context)\s*$"
_FENCE = r"(?sd)```[^\n]*\n(.*?)```"
_HINT = r"\(Open file:\s*([^)\r\n]+)\)"


def _some(*columns: Column) -> Column:
    """The first that is neither null nor empty, else null."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def _first_line(action: Column) -> Column:
    return strip(F.regexp_extract(strip(action), r"(?d)\A([^\n]*)", 1))


def _event(**given: Column) -> Column:
    names = [x.split(":")[0] for x in EVENT[7:-1].split(",")]
    kinds = dict(x.split(":") for x in EVENT[7:-1].split(","))
    return F.struct(*(given.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names))


def _known(path: Column) -> Column:
    """An editor hint that names a file."""
    return F.when(F.lower(path) != "n/a", F.nullif(path, F.lit("")))


def _own_path(a: Column) -> Column:
    """The file that a command line names for the editor."""
    first = _first_line(a)
    return F.nullif(repo_relative(F.concat(F.regexp_extract(first, _OPEN, 1), F.regexp_extract(first, _CREATE, 1))), F.lit(""))


def _tool_path(name: Column, args: Column) -> Column:
    a = F.from_json(args, "path string, file_name string")
    edits = name.isin([t for t, k in TOOLS_B.items() if k in ("read", "edit")])
    return F.when(edits, F.nullif(repo_relative(_some(a["path"], a["file_name"])), F.lit("")))


def _calls(m: Column, i: Column, thought: Column, hints: bool) -> Column:
    def one(c: Column) -> Column:
        name = F.coalesce(F.nullif(c["function"]["name"], F.lit("")), F.lit("unknown"))
        more = {"hint": _tool_path(name, c["function"]["arguments"])} if hints else {}
        return _event(at=i, step=F.lit(True), id=c["id"], tool=name, args=F.coalesce(c["function"]["arguments"], F.lit("{}")), thought=F.nullif(thought, F.lit("")), **more)

    return F.transform(F.filter(m["tool_calls"], lambda c: c.isNotNull()), one)


def _say(i: Column, thought: Column) -> Column:
    return F.array(_event(at=i, step=F.lit(True), thought=thought))


def _call_events(m: Column, i: Column) -> Column:
    """Assistant turns with tool calls, and tool turns that answer them by id."""
    content = clean_output(m["content"])
    return (
        F.when((m["role"] == "assistant") & (F.size(m["tool_calls"]) > 0), _calls(m, i, content, False))
        .when((m["role"] == "assistant") & (strip(content) != ""), _say(i, content))
        .when((m["role"] == "tool") & (F.length(m["tool_call_id"]) > 0), F.array(_event(at=i, step=F.lit(False), id=m["tool_call_id"], observation=content)))
        .otherwise(F.expr(_NONE))
    )


def _history_events(m: Column, i: Column) -> Column:
    thought = clean_output(_some(m["thought"], m["content"]))
    content = clean_output(m["content"])
    ids = F.when(F.size(m["tool_call_ids"]) > 0, m["tool_call_ids"]).when(F.length(m["tool_call_id"]) > 0, F.array(m["tool_call_id"])).otherwise(F.array(F.lit("")))
    hint = _known(repo_relative(F.regexp_extract(content, _HINT, 1)))
    return (
        F.when((m["role"] == "assistant") & (F.size(m["tool_calls"]) > 0), _calls(m, i, thought, True))
        .when((m["role"] == "assistant") & (strip(F.coalesce(m["action"], F.lit(""))) != ""), F.array(_event(at=i, step=F.lit(True), thought=F.nullif(thought, F.lit("")), action=strip(m["action"]), hint=_own_path(m["action"]))))
        .when((m["role"] == "assistant") & (thought != ""), _say(i, thought))
        .when(m["role"] == "tool", F.transform(ids, lambda x: _event(at=i, step=F.lit(False), id=F.nullif(x, F.lit("")), observation=content, hint=hint)))
        .otherwise(F.expr(_NONE))
    )


def _stream_events(m: Column, i: Column) -> Column:
    """Turns of a role/text stream, without the first user turn: the action is the last fenced block, the next user turn its result."""
    t = F.coalesce(m["text"], F.lit(""))
    blocks = F.regexp_extract_all(t, F.lit(_FENCE), F.lit(1))
    action = strip(F.try_element_at(blocks, F.lit(-1)))
    # what lies before the last block: the gaps before it and the blocks between them
    chars = lambda a, n: F.aggregate(F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.lit(0), lambda x, y: x + F.length(y))
    upto = chars(F.split(t, _FENCE), F.size(blocks)) + chars(F.regexp_extract_all(t, F.lit(_FENCE), F.lit(0)), F.size(blocks) - 1)
    thought = F.nullif(F.when(F.size(blocks) > 0, strip(clean_output(F.left(t, upto)))).otherwise(clean_output(t)), F.lit(""))
    text = clean_output(m["text"])
    return (
        F.when(m["role"] == "ai", F.array(_event(at=i, step=F.lit(True), thought=thought, action=F.coalesce(action, F.lit("")), hint=_own_path(F.coalesce(action, F.lit(""))))))
        .when(m["role"] == "user", F.array(_event(at=i, step=F.lit(False), observation=text, hint=_known(repo_relative(F.regexp_extract(text, _HINT, 1))))))
        .otherwise(F.expr(_NONE))
    )


def _listed_events(m: Column, i: Column) -> Column:
    """Step objects: the state before a step names the open file, so its hint counts for the step itself."""
    state = repo_relative(F.get_json_object(m["state"], "$.open_file"))
    return F.array(_event(at=i, step=F.lit(True), thought=F.nullif(clean_output(m["thought"]), F.lit("")), action=strip(F.coalesce(m["action"], F.lit(""))), state=m["state"], hint=F.nullif(state, F.lit("")), observation=clean_output(m["observation"])))


class Adapter(NamedTuple):
    """How one serialization is recognised and read."""

    framework: str
    score: Callable[[], Column]  # over head, messages
    messages: str  # the head's field that holds them
    events: Callable[[Column, Column], Column]
    answers: str  # "id", "next" or "own"
    order: int


def _roles() -> Column:
    return F.transform("messages", lambda m: m["role"])


def _head(n: int) -> Column:
    return F.filter(F.slice("messages", 1, n), lambda m: m.isNotNull())


def _has(names: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(_roles(), F.array(*map(F.lit, names))), F.lit(False))


def _stepwise() -> Column:
    return F.size("head.trajectory") > 0


def _score_calls() -> Column:
    return F.when(_stepwise() & ~_has(["ai"]) & _has(["assistant", "tool"]), 1.0).otherwise(0.0)


def _all_roles() -> Column:
    return F.forall(_head(5), lambda m: m["role"].isNotNull())


def _score_stream() -> Column:
    """A run that acted; or one with an opening only, told by its role names and its ``text``."""
    opening = F.forall("messages", lambda m: m["role"].isNull() | m["role"].isin("ai", "system", "user")) & F.forall(_head(5), lambda m: m["text"].isNotNull()) & F.exists("messages", lambda m: m["role"].isNotNull())
    return F.when(_stepwise() & _all_roles() & _has(["ai"]), 1.0).when(_stepwise() & _all_roles() & opening, 0.8).otherwise(0.0)


def _score_listed() -> Column:
    acts = F.exists(_head(5), lambda m: m["action"].isNotNull() | m["thought"].isNotNull())
    sure = F.col("head.environment").isNotNull() | F.col("head.info").isNotNull()
    return F.when(_stepwise() & ~_all_roles() & acts, F.when(sure, 1.0).otherwise(0.7)).otherwise(0.0)


def _score_history() -> Column:
    chat = ~F.coalesce(_stepwise(), F.lit(False)) & (F.size("head.history") > 0) & F.exists(_head(10), lambda m: m["role"].isNotNull())
    return F.when(chat, F.when(F.exists(_head(10), lambda m: F.length(m["message_type"]) > 0), 0.9).otherwise(0.3)).otherwise(0.0)


ADAPTERS: dict[str, Adapter] = {}


def register_adapter(name: str, framework: str, score: Callable[[], Column], messages: str, events: Callable[[Column, Column], Column], answers: str) -> None:
    """Adds a serialization; of equal scores the one registered first is taken."""
    ADAPTERS[name] = Adapter(framework, score, messages, events, answers, len(ADAPTERS))


register_adapter("calls", "openhands", _score_calls, "trajectory", _call_events, "id")
register_adapter("stream", "sweagent", _score_stream, "trajectory", _stream_events, "next")
register_adapter("listed", "sweagent", _score_listed, "trajectory", _listed_events, "own")
register_adapter("history", "sweagent", _score_history, "history", _history_events, "id")


def frameworks() -> list[str]:
    return sorted({a.framework for a in ADAPTERS.values()})


def recognised(records: DataFrame, framework: str | None = None) -> DataFrame:
    """``records`` with head, messages and ``shape``, the adapter that fits best. A record that none fits stops the query; ``framework`` limits the choice.

    A forced framework reads records that it doesn't recognise as its plainest shape, which may give no steps.
    """
    if framework is not None and framework not in frameworks():
        raise ValueError(f"unknown framework: {framework!r}")
    own = {n: a for n, a in ADAPTERS.items() if framework in (None, a.framework)}
    d = records.withColumn("head", F.from_json("record", HEAD))
    texts = F.when(F.size("head.trajectory") > 0, F.col("head.trajectory")).otherwise(F.coalesce("head.history", F.array().cast("array<string>")))
    d = d.withColumn("messages", settled(F.transform(texts, lambda x: F.from_json(x, MESSAGE))))
    scores = F.array(*(F.struct(a.score().alias("s"), F.lit(-a.order).alias("o"), F.lit(n).alias("n")) for n, a in own.items()))
    d = d.withColumn("_best", settled(F.array_max(scores)))
    if framework is None:
        fallback = F.raise_error(F.concat(F.lit("no adapter recognises the record at "), F.col("run_key"))).cast("string")
    else:
        fallback = F.lit({"openhands": "calls", "sweagent": "listed"}.get(framework, next(iter(own))))
    return d.withColumn("shape", F.when(F.col("_best.s") > 0, F.col("_best.n")).otherwise(fallback)).drop("_best")


def _messages_of(name: str, a: Adapter) -> Column:
    """The messages that count, each with its place."""
    placed = F.transform("messages", lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    if a.answers == "own":
        return placed
    if a.answers == "id":
        return F.filter(placed, lambda x: x["m"]["role"].isNotNull())
    users = F.filter(F.transform("messages", lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull())
    return F.filter(placed, lambda x: x["m"]["role"].isin("user", "ai") & ~x["i"].eqNullSafe(F.get(users, F.lit(0))))


def _answered(d: DataFrame) -> DataFrame:
    """``d`` (events, answers) with ``raw``: its steps with their results and the editor's open file.

    By id, a step's result is the latest answer after it and before a later call of that id; ids that don't repeat are looked up directly.
    Each stage names its arrays as columns that are read more than once, so they are made once for a record and not once for a step.
    """
    d = d.withColumn("own", F.filter(F.transform("events", lambda e, k: F.struct(e.alias("e"), k.alias("k"))), lambda x: x["e"]["step"])).withColumn("said", F.filter("events", lambda e: ~e["step"] & e["id"].isNotNull()))
    d = d.withColumn("ids", F.transform("said", lambda e: e["id"])).withColumn("called", F.filter(F.transform("own", lambda x: x["e"]["id"]), lambda i: F.length(i) > 0))
    d = d.withColumn("places", F.transform("events", lambda e, k: F.when(e["hint"].isNotNull(), k).otherwise(F.lit(-1))))
    d = d.withColumn("plain", (F.size(F.array_distinct("ids")) == F.size("ids")) & (F.size(F.array_distinct("called")) == F.size("called")))

    def quick(e: Column) -> Column:
        found = F.get("said", F.array_position(F.col("ids"), F.coalesce(e["id"], F.lit(""))).cast("int") - 1)
        return F.when(found["at"] > e["at"], found["observation"])

    def exact(x: Column) -> Column:
        e, k = x["e"], x["k"]
        between = lambda a: F.exists("own", lambda y: (y["k"] > k) & (y["e"]["id"] == e["id"]) & (y["e"]["at"] < a["at"]))
        return F.try_element_at(F.filter("said", lambda a: (a["id"] == e["id"]) & (a["at"] > e["at"]) & ~between(a)), F.lit(-1))["observation"]

    def one(x: Column) -> Column:
        e, k, own = x["e"], x["k"], F.col("answers") == "own"
        after = F.get("events", k + 1)
        result = F.when(own, e["observation"]).when(F.col("answers") == "next", F.when(~after["step"], after["observation"])).when(F.length(e["id"]) > 0, F.when(F.col("plain"), quick(e)).otherwise(exact(x)))
        last = F.array_max(F.slice("places", F.lit(1), k + F.when(own, 1).otherwise(0)))
        pointer = F.get("events", F.coalesce(last, F.lit(-1)))["hint"]
        return F.struct(*(e[n].alias(n) for n in ("tool", "args", "thought", "action", "state")), result.alias("observation"), pointer.alias("pointer"))

    return d.withColumn("raw", settled(F.transform("own", one))).drop("own", "said", "ids", "called", "places", "plain", "events", "answers")


def _typed(exploded: DataFrame) -> DataFrame:
    """Exploded raw steps (framework, tool, args, thought, action, pointer, observation) -> the columns of the normalized schema."""
    s = exploded.withColumn("a", settled(F.from_json("args", _ARGS))).withColumn("v", F.try_parse_json("args")).withColumn("first", F.when(F.col("action").isNotNull(), _first_line(F.col("action"))))
    a, first, oh = (lambda n: F.col("a")[n]), F.col("first"), F.col("framework") == "openhands"
    line, called, pointer = F.col("action").isNotNull() & (F.col("action") != ""), F.col("tool").isNotNull(), F.coalesce("pointer", F.lit(""))
    verb_a = F.when(F.col("tool") == "str_replace_editor", F.coalesce(_some(a("command")), F.lit("view"))).when(F.col("tool") == "task_tracker", F.coalesce(_some(a("command")), F.lit("plan")))
    table = lambda t: F.try_element_at(F.create_map(*(F.lit(x) for kv in t.items() for x in kv)), F.col("tool"))
    by_tool = F.when(oh, F.when((F.col("tool") == "str_replace_editor") & (verb_a == "view"), "read").otherwise(table(TOOLS_A))).otherwise(table(TOOLS_B))
    by_line = F.when(first.rlike(_SUBMIT), "submit").when(first.rlike(_MOVE) | first.rlike(_OPEN), "read").when(first.rlike(_CREATE) | first.rlike(_EDIT) | first.startswith("undo_edit"), "edit").when(first.rlike(_FIND) | first.rlike(_SEARCH), "search").otherwise("shell")
    s = s.withColumn("kind", settled(F.when(called, F.coalesce(by_tool, F.lit("other"))).when(line, by_line).otherwise("thought"))).withColumn("by", F.when(called & oh, "a").when(called, "b").when(line, "line").otherwise("say"))
    kind, by = F.col("kind"), F.col("by")
    word = F.regexp_extract(first, r"(?U)(\S+)", 1)
    verb_b = F.when(kind == "read", "view").when(kind == "search", "search").when(kind == "edit", F.when(F.col("tool").isin("create", "create_file"), "create").when(F.col("tool") == "insert", "insert").otherwise("str_replace"))
    verb_l = (
        F.when(kind == "read", F.when(first.rlike(_MOVE), "navigate").otherwise("view")).when(kind == "search", F.when(first.rlike(_FIND), "find_file").otherwise("search"))
        .when(kind == "edit", F.when(first.rlike(_CREATE), "create").when(first.rlike(_EDIT), "str_replace").otherwise("undo_edit"))
    )
    s = s.withColumn("verb", F.when(by == "a", verb_a).when(by == "b", verb_b).when(by == "line", verb_l))
    verb = F.col("verb")
    given = repo_relative(_some(a("path"), a("file_name")))
    found = F.when(first.rlike(_FIND), F.regexp_extract(first, _FIND, 2)).otherwise(F.regexp_extract(first, _SEARCH, 2))
    path_l = F.when(verb.isin("navigate", "str_replace", "undo_edit"), pointer).when(verb == "view", repo_relative(F.regexp_extract(first, _OPEN, 1))).when(verb == "create", repo_relative(F.regexp_extract(first, _CREATE, 1))).when(kind == "search", repo_relative(found))
    path = F.when((by == "a") & (F.col("tool") == "str_replace_editor"), repo_relative(a("path"))).when((by == "b") & (kind == "read"), given).when((by == "b") & (kind == "edit"), F.coalesce(F.nullif(given, F.lit("")), pointer)).when(by == "line", path_l)
    body = F.regexp_replace(F.regexp_replace(F.split_part(F.substr("action", F.length("first") + 1), F.lit("end_of_edit"), F.lit(1)), r"\A\n+", ""), r"\n+\z", "")
    pattern_l = F.regexp_replace(F.when(first.rlike(_FIND), F.regexp_extract(first, _FIND, 1)).otherwise(F.regexp_extract(first, _SEARCH, 1)), r"""\A["']+|["']+\z""", "")
    pattern_b = F.coalesce(_some(a("file_name"), a("search_term"), a("pattern"), a("query")), F.lit(""))
    say = F.coalesce("thought", F.lit(""))
    editor = (by == "a") & (F.col("tool") == "str_replace_editor")
    raw = lambda n: F.expr(f"try_variant_get(v, '$.{n}', 'string')")
    s = s.select(
        "run_key", "idx", "framework", "kind", "by", "tool", "args", "v", "observation",
        F.when((by == "a") & (F.col("tool") == "think"), F.coalesce(_some(a("thought"), F.col("thought")), F.lit(""))).otherwise(F.col("thought")).alias("thought"),
        F.coalesce("tool", F.when(by == "say", "think").when(kind == "submit", "submit").when(kind == "shell", "bash").when((kind == "edit") & (verb == "undo_edit"), "undo_edit").otherwise(word)).alias("raw_tool"),
        verb.alias("verb"), path.alias("path"),
        F.when(kind == "shell", F.when(by == "line", F.col("action")).when(by == "a", F.coalesce(a("command"), F.lit(""))).otherwise(F.coalesce(_some(a("command"), a("cmd")), F.lit("")))).alias("command"),
        F.when((kind == "search") & (by == "b"), pattern_b).when((kind == "search") & (by == "line"), pattern_l).alias("pattern"),
        F.when(editor, a("old_str")).when((by == "b") & (kind == "edit"), _some(a("search"), a("old_str"))).alias("old_str"),
        F.when(editor, a("new_str")).when((by == "b") & (kind == "edit"), _some(a("replace"), a("new_str"), a("text"))).when((by == "line") & (verb == "str_replace"), body).alias("new_str"),
        F.when(editor | ((by == "b") & (kind == "edit")), a("file_text")).when((by == "line") & (verb == "create"), body).alias("file_text"),
        F.when(editor, raw("view_range")).alias("view_range"),
        F.when((by == "line") & (verb == "view"), F.nullif(F.regexp_extract(first, _OPEN, 2), F.lit(""))).alias("line_no"), F.when((by == "line") & (verb == "str_replace"), F.nullif(F.regexp_extract(first, _EDIT, 1), F.lit(""))).alias("span"),
        "action", say.alias("say"), F.coalesce(a("message"), F.lit("")).alias("message"), F.col("state"),
    )
    part = lambda n: F.expr(f"try_variant_get(v, '$.{n}', 'variant')").alias(n)
    js = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    c = F.col
    by, kind, verb = c("by"), c("kind"), c("verb")
    args = (
        F.when(by == "say", js(c("say").alias("thought"))).when((by == "a") & (kind == "thought"), js("thought")).when((by == "a") & (kind == "submit"), js("message")).when((by == "a") & (kind == "plan"), js("verb", part("task_list")))
        .when((by == "a") & (kind == "shell"), js("command", part("timeout"))).when((by == "a") & kind.isin("read", "edit"), js("path", "verb", part("view_range"), part("old_str"), part("new_str"), part("file_text"), part("insert_line")))
        .when(kind == "submit", "{}").when(kind == "shell", js("command")).when((by == "b") & (kind == "read"), js("path", "verb")).when((by == "b") & (kind == "search"), js("pattern", "verb"))
        .when((by == "b") & (kind == "edit"), js("path", "verb", "old_str", "new_str", "file_text", part("insert_line"))).when(kind == "other", "args").when(verb == "navigate", js("path", "verb"))
        .when(verb == "view", js("path", c("line_no").alias("line"), "verb")).when(verb == "create", js("path", "verb", "file_text")).when(verb == "str_replace", js("path", "verb", c("span").alias("range"), "new_str")).when(verb == "undo_edit", js("path", "verb"))
        .otherwise(js("pattern", "path", "verb"))
    )
    # an argument text that is no object keeps what it said
    args = F.when(kind == "other", F.when(c("args").rlike(r"(?s)\A\s*\{") & c("v").isNotNull(), c("args")).when(strip(c("args")) == "", "{}").otherwise(F.to_json(F.struct(c("args").alias("_raw"))))).otherwise(args)
    action = (
        F.when(by == "line", c("action")).when(by == "say", F.coalesce(c("action"), c("say"))).when(kind == "shell", c("command")).when((by == "a") & (kind == "thought"), c("thought"))
        .when((by == "a") & (kind == "submit"), "finish").when(kind == "submit", c("tool")).when(kind == "plan", F.concat(F.lit("task_tracker "), "verb")).when((by == "b") & (kind == "read"), F.concat(F.lit("open "), "path"))
        .when(kind.isin("read", "edit"), F.concat_ws(" ", "verb", "path")).when(kind == "search", F.concat_ws(" ", "tool", "pattern")).otherwise(F.concat_ws(" ", "tool", "args"))
    )
    files = F.when(kind.isin("read", "edit") & (F.coalesce("path", F.lit("")) != ""), F.array("path")).otherwise(F.array().cast("array<string>"))
    return s.select(
        "run_key", "idx", "kind", "thought", "raw_tool", action.alias("raw_action"), args.alias("args"), "path", F.when(kind.isin("read", "edit", "search", "plan"), verb).alias("verb"), "command", "pattern", "old_str", "new_str", "file_text", "view_range",
        "observation", files.alias("files_touched"), "state", F.lit("{}").alias("meta"),
    )


def derived(steps: DataFrame) -> DataFrame:
    """``steps`` with exit_code, error_kind, error_fp (of kinds that carry errors) and is_test_run."""
    bears = F.col("kind").isin(list(ERROR_BEARING))
    out = steps.withColumn("_obs", F.when(bears, F.col("observation")))
    return with_errors(out, "_obs", own_code="exit_code").drop("_obs").withColumn("is_test_run", (F.col("kind") == "shell") & P.is_test_command("command"))


def _resolved(raw: Column) -> Column:
    return F.when(F.lower(raw).isin("true", "1", "1.0"), True).when(F.lower(raw).isin("false", "0", "0.0"), False)


def parsed(records: DataFrame, framework: str | None = None) -> DataFrame:
    """One row a record: the run's columns, and ``raw``, the array of its steps before they are typed."""
    d, own = recognised(records, framework), [(n, a) for n, a in ADAPTERS.items() if framework in (None, a.framework)]
    by_shape = lambda what: reduce(lambda rest, x: F.when(F.col("shape") == x[0], what(*x)).otherwise(rest), reversed(own[:-1]), what(*own[-1]))
    d = d.withColumn("events", settled(by_shape(lambda n, a: F.flatten(F.transform(_messages_of(n, a), lambda x: a.events(x["m"], x["i"])))))).withColumn("answers", by_shape(lambda n, a: F.lit(a.answers)))
    d = _answered(d.withColumn("framework", by_shape(lambda n, a: F.lit(a.framework))))
    name = F.col("shape")
    h, i = (lambda x: F.col("head")[x]), (lambda x: F.col("head")["info"][x])
    oh = F.col("shape") == "calls"
    user = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))
    system = F.try_element_at(F.filter("messages", lambda m: m["role"] == "system"), F.lit(-1))
    problem = F.when(name == "listed", F.nullif(clean_output(h("problem_statement")), F.lit(""))).when(name == "stream", F.when(user.isNotNull(), clean_output(user["text"]))).otherwise(F.when(user.isNotNull(), clean_output(user["content"])))
    raw_resolved = F.coalesce(h("resolved"), F.when(~oh, F.coalesce(i("resolved"), h("target"))))
    instance = F.coalesce(F.when(oh, _some(h("instance_id"), h("trajectory_id"))).otherwise(_some(h("instance_id"), i("instance_id"), h("environment"))), F.lit("unknown"))
    pick = lambda *c: F.coalesce(_some(*c), c[-1])  # noqa: E731  the last may be empty
    meta = F.to_json(F.struct(F.size("messages").alias("n_messages"), name.alias("serialization"), h("trajectory_id").alias("trajectory_id"), h("environment").alias("environment"), F.coalesce(h("model_name"), i("model_name")).alias("model_name"), F.when(system.isNotNull(), clean_output(F.coalesce(system["content"], system["text"]))).alias("system_prompt"), h("gen_tests_correct").alias("gen_tests_correct"), h("pred_passes_gen_tests").alias("pred_passes_gen_tests")))
    return d.select(
        "run_key", "file", "block", "ord", instance.alias("instance_id"), "framework", _resolved(raw_resolved).alias("resolved"), raw_resolved.alias("resolved_raw"), F.when(oh, h("repo")).otherwise(pick(i("repo"), h("repo"))).alias("repo"),
        problem.alias("problem_statement"), F.when(oh, h("model_patch")).otherwise(pick(h("model_patch"), i("model_patch"), h("generated_patch"))).alias("model_patch"), F.when(oh, h("exit_status")).otherwise(pick(h("exit_status"), i("exit_status"))).alias("exit_status"),
        h("trajectory_id").alias("upstream_id"), F.array().cast("array<string>").alias("gold_files"), meta.alias("meta"), "raw",
    )


def steps_of(runs: DataFrame) -> DataFrame:
    """The typed and derived steps of ``parsed`` rows."""
    e = runs.select("run_key", "framework", F.posexplode_outer("raw").alias("idx", "r")).filter("idx IS NOT NULL").select("run_key", "framework", "idx", "r.*")
    return derived(_typed(e))


def load(spark: SparkSession, path: str | list[str], framework: str | None = None, gold: str | DataFrame | None = None, on_empty: str = "warn", limit: int | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(runs, steps) of every record under ``path``.

    ``limit``: only the first records, in stored order, that have steps. Records without steps mean that no adapter understood them: they are left out with a
    warning, or stop the load (``on_empty="error"``). ``gold``: a sidecar's path or a table of instance_id and files.
    """
    if on_empty not in ("warn", "error"):
        raise ValueError(f"on_empty must be 'warn' or 'error', not {on_empty!r}")
    if limit is not None and limit < 0:
        raise ValueError("limit must be non-negative")
    return loaded(parsed(read_records(spark, path, strict), framework), load_gold(spark, gold) if isinstance(gold, str) else gold, on_empty, limit)


def loaded(rows: DataFrame, gold: DataFrame | None = None, on_empty: str = "warn", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, steps) from ``parsed`` rows; see ``load``."""
    if on_empty == "error":
        said = F.concat(F.lit("parsed into zero steps: "), F.col("run_key"))
        rows = rows.withColumn("raw", F.when(F.size("raw") > 0, F.col("raw")).otherwise(F.raise_error(said).cast(rows.schema["raw"].dataType)))
    elif not rows.isStreaming and limit is None:
        empty = [r.run_key for r in rows.filter(F.size("raw") == 0).select("run_key").limit(6).collect()]
        if empty:
            warnings.warn(f"records that parsed into zero steps are left out: {', '.join(empty[:5])}{' and more' * (len(empty) > 5)}", RuntimeWarning, stacklevel=2)
    rows = rows.filter(F.size("raw") > 0)
    if limit is not None:
        rows = rows.orderBy("file", "block", "ord").limit(limit)
    runs = rows.drop("raw", "file", "block", "ord")
    return attach_gold(runs, gold) if gold is not None else runs, steps_of(rows)
