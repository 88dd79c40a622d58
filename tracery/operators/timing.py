"""Where a session's time goes: its turns with tools, their calls, sub-sessions, categories.

Frames: messages (session_id, ordinal, ts, has_tool_use), calls (session_id, ordinal, call_index, category, tool_name, input: JSON text,
child: the session that the call started, or null), events (session_id, ordinal, call_index, event_index, source, status, ts),
sessions (session_id, started_at, ended_at: null while it runs). Times are in whole milliseconds. `now` stands for the end of what still runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which argument of a tool shows what it was called for, by category (or, for the vague ones, by tool).
VAGUE = ["", "Other", "Tool"]
ARGUMENTS = {
    "Read": ["file_path", "path"],
    "Edit": ["file_path", "path", "filePath", "file"],
    "Write": ["file_path", "path", "file"],
    "Grep": ["pattern", "query"],
    "Glob": ["pattern", "path"],
    "Bash": ["command", "cmd"],
    "Skill": ["skill", "name"],
    "skill": ["skill", "name"],
}
OTHER_ARGUMENTS = ["file_path", "path", "pattern", "command", "cmd"]
PREVIEW = 100
TURN = ["session_id", "ordinal"]


def millis(since: Column, until: Column) -> Column:
    """Whole milliseconds from one time to another, cut towards zero."""
    return F.call_function("div", F.unix_micros(until) - F.unix_micros(since), F.lit(1000))


def preview(category: Column, tool: Column, arguments: Column) -> Column:
    """The first argument that is a text and not empty, up to PREVIEW characters, of a command its first line; '' without one or for what isn't JSON."""
    tree = F.try_parse_json(arguments)

    def first(names: list[str]) -> Column:
        texts = []
        for name in names:
            at = F.try_variant_get(tree, f"$.{name}", "variant")
            texts.append(F.nullif(F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(tree, f"$.{name}", "string")), F.lit("")))
        return F.coalesce(*texts)

    kind = F.when(F.coalesce(category, F.lit("")).isin(VAGUE), tool).otherwise(category)
    shown = first(OTHER_ARGUMENTS)
    for name, names in ARGUMENTS.items():
        own = first(names)
        shown = F.when(kind == name, F.substring_index(own, "\n", 1) if name == "Bash" else own).otherwise(shown)
    shown = F.coalesce(shown, F.lit(""))
    return F.when(F.char_length(shown) > PREVIEW, F.concat(F.substring(shown, 1, PREVIEW), F.lit("…"))).otherwise(shown)


def own_times(calls: DataFrame, events: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Calls with `took` and `completed`: a call of a sub-session took what that took; else it took from its first start to its last end among its
    execution events, where both are told and in order, and was completed then.
    """
    ran = events.where("source = 'tool_execution' and ts is not null").groupBy(*TURN, "call_index").agg(
        F.min_by("ts", F.when(F.col("status") == "started", F.col("event_index"))).alias("began"),
        F.max_by("ts", F.when(F.col("status").isin("completed", "errored"), F.col("event_index"))).alias("finished"))
    below = sessions.where("started_at is not null").select(F.col("session_id").alias("child"), millis(F.col("started_at"), F.coalesce("ended_at", now)).alias("child_ms"))
    rows = calls.join(ran, [*TURN, "call_index"], "left").join(below, "child", "left")
    span = millis(F.col("began"), F.col("finished"))
    told = F.col("child_ms").isNull() & (span >= 0)
    return rows.withColumns({"took": F.coalesce("child_ms", F.when(told, span)), "completed": F.when(told, F.col("finished"))}).drop("began", "finished", "child_ms")


def turn_times(messages: DataFrame, sessions: DataFrame, own: DataFrame) -> DataFrame:
    """Turns with tools: ms, calls, children, the category that they count for, and how their time is split.

    A turn lasts to the next message, the last one to its session's end; where every call has a completion, to the last of these. None if that is
    before its start. The longest sub-session is taken off (`rest` remains). If that was at least half, the turn is a Task; else it is what more than
    half of its other calls are; else Mixed. task_ms and tasks: what its sub-sessions took, those above zero.
    """
    below = F.col("child").isNotNull() & F.col("took").isNotNull()
    kinds = own.groupBy(*TURN, "category").agg(
        F.count(F.lit(1)).alias("n"), F.count("child").alias("children"), F.count("completed").alias("ends"), F.max("completed").alias("boundary"), F.count_if(~below).alias("others"),
        F.max(F.when(below, F.col("took"))).alias("longest"), F.sum(F.when(below & (F.col("took") > 0), F.col("took"))).alias("task_ms"), F.count_if(below & (F.col("took") > 0)).alias("tasks"))
    per = kinds.groupBy(*TURN).agg(
        *(F.sum(c).alias(c) for c in ("n", "children", "ends", "others", "task_ms", "tasks")), F.max("boundary").alias("boundary"), F.max("longest").alias("longest"),
        F.max(F.struct("others", F.coalesce("category", F.lit("")).alias("category"))).alias("most"))
    after = F.lead("ts").over(Window.partitionBy("session_id").orderBy("ordinal"))
    turns = messages.select(*TURN, "ts", "has_tool_use", after.alias("after")).where("has_tool_use")
    turns = turns.join(sessions.select("session_id", "ended_at"), "session_id", "left").join(per, TURN, "left").na.fill(0, ["n", "children", "ends", "others", "task_ms", "tasks"])
    lasted, cut = millis(F.col("ts"), F.coalesce("after", "ended_at")), F.coalesce(millis(F.col("ts"), F.col("boundary")), F.lit(0))
    turns = turns.withColumn("ms", F.when((F.col("n") > 0) & (F.col("ends") == F.col("n")) & (cut >= 0), cut).otherwise(F.when(lasted >= 0, lasted)))
    off = F.greatest(F.coalesce("longest", F.lit(0)), F.lit(0))
    rest = F.greatest(F.col("ms") - off, F.lit(0))
    kind = F.when((off > 0) & (off >= rest), "Task").when(F.col("most.others") * 2 > F.col("others"), F.col("most.category")).otherwise("Mixed")
    known = F.col("ms").isNotNull()
    return turns.select(
        *TURN, "ts", "ms", F.col("n").alias("calls"), "children", F.when(known, kind).otherwise("Mixed").alias("category"), F.when(known, rest).otherwise(0).alias("rest"),
        F.when(known, F.col("task_ms")).otherwise(0).alias("task_ms"), F.when(known, F.col("tasks")).otherwise(0).alias("tasks"))


def call_times(own: DataFrame, turns: DataFrame) -> DataFrame:
    """Calls of turns with tools: ms (a call alone in its turn that tells no time took the turn's), whether others ran beside it, and what it was called for."""
    rows = own.join(turns.select(*TURN, F.col("ms").alias("turn_ms"), F.col("calls").alias("n")), TURN)
    alone = (F.col("n") == 1) & F.col("child").isNull()
    return rows.select(*TURN, "call_index", "category", "tool_name", "child", F.coalesce("took", F.when(alone, F.col("turn_ms"))).alias("ms"), (F.col("n") > 1).alias("parallel"), preview(F.col("category"), F.col("tool_name"), F.col("input")).alias("preview"))


def category_times(turns: DataFrame) -> DataFrame:
    """Time and calls of each session and category: what remains of a turn counts for its category with all its calls, each sub-session for Task; nothing of no time counts."""
    parts = F.array(F.struct(F.col("category"), F.col("rest").alias("ms"), F.col("calls")), F.struct(F.lit("Task").alias("category"), F.col("task_ms").alias("ms"), F.col("tasks").alias("calls")))
    return turns.select("session_id", F.inline(parts)).where("ms > 0").groupBy("session_id", "category").agg(F.sum("ms").alias("ms"), F.sum("calls").alias("calls"))


def session_times(sessions: DataFrame, turns: DataFrame, calls: DataFrame, now: Column) -> DataFrame:
    """One row for each session: its whole time and that of its turns with tools, counts, and the slowest call (ties to the first)."""
    of_turns = turns.groupBy("session_id").agg(F.sum("ms").alias("tool_ms"), F.count(F.lit(1)).alias("turns"), F.sum("calls").alias("calls"), F.sum("children").alias("children"))
    at = F.struct((-F.col("ms")).alias("t"), "ordinal", "call_index")
    slow = calls.where("ms is not null").groupBy("session_id").agg(F.min_by(F.struct("ordinal", "call_index", "ms", "preview"), at).alias("s"))
    whole = F.coalesce(millis(F.col("started_at"), F.coalesce("ended_at", now)), F.lit(0))
    rows = sessions.select("session_id", whole.alias("total_ms"), F.col("ended_at").isNull().alias("running")).join(of_turns, "session_id", "left").join(slow, "session_id", "left")
    return rows.na.fill(0, ["tool_ms", "turns", "calls", "children"]).select("session_id", "total_ms", "running", "tool_ms", "turns", "calls", "children", F.col("s.ordinal").alias("slowest_ordinal"), F.col("s.call_index").alias("slowest_call"), F.col("s.ms").alias("slowest_ms"), F.col("s.preview").alias("slowest_preview"))
