"""Session and message filters: pure predicates and semi-joins, so that Catalyst pushes them to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Tables

#: What user turns that an agent injected begin with.
SYSTEM_PREFIXES = ["This session is being continued", "[Request interrupted", "<task-notification>", "<command-message>", "<command-name>", "<local-command-", "Stop hook feedback:"]


def visible(sessions: DataFrame, subagents: bool = False) -> DataFrame:
    """Sessions with messages that are no forks, nor (unless asked for) subagents."""
    kinds = ["", "continuation", *(["subagent"] if subagents else [])]
    return sessions.where((F.col("message_count") > 0) & F.col("relationship").isin(kinds))


def local_date(ts: str, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.col(ts), tz))


def in_dates(df: DataFrame, ts: str, first: str, last: str, tz: str = "UTC") -> DataFrame:
    """Rows whose local date is in [first, last]. A range padded by 14 hours goes to the scan, the exact one follows (F2)."""
    pad = "interval 14 hours"
    near = F.col(ts).between(F.expr(f"timestamp'{first}' - {pad}"), F.expr(f"timestamp'{last}' + interval 1 day + {pad}"))
    return df.where(near & local_date(ts, tz).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def automation(scope: str) -> Column:
    """human, automated or all (F8)."""
    return {"human": ~F.col("is_automated"), "automated": F.col("is_automated"), "all": F.lit(True)}[scope]


def not_one_shot(scope: str = "human") -> Column:
    """Sessions of more than one user message; automated ones are exempt outside the human scope."""
    many = F.col("user_message_count") > 1
    return many if scope == "human" else many | F.col("is_automated")


def analytics_filter(t: Tables, first: str = "2024-01-03", last: str = "2024-01-24", tz: str = "UTC", scope: str = "human", projects: list[str] | None = None, models: list[str] | None = None, min_user: int = 0, one_shots: bool = False) -> DataFrame:
    """The filter that all dashboard queries share (F1)."""
    out = in_dates(visible(t.sessions), "started_at", first, last, tz).where(automation(scope) & (F.col("user_message_count") >= min_user))
    if not one_shots:
        out = out.where(not_one_shot(scope))
    if projects is not None:
        out = out.where(F.col("project").isin(projects))
    if models is not None:
        out = out.join(t.messages.where(F.col("model").isin(models)).select("session_id"), "session_id", "left_semi")
    return out


def day_hour_filter(t: Tables, day: int, hour: int, tz: str = "UTC") -> DataFrame:
    """Sessions with a message on this local weekday (Monday 0) and hour."""
    local = F.from_utc_timestamp("ts", tz)
    return t.sessions.join(t.messages.where((F.weekday(local) == day) & (F.hour(local) == hour)).select("session_id"), "session_id", "left_semi")


def model_scope(messages: DataFrame, models: list[str]) -> DataFrame:
    """Rows of the selected models, and user turns without a model whose next assistant is of one, whatever else comes between."""
    ahead = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.col("role") == "assistant", F.col("model")), ignorenulls=True).over(ahead)
    own = F.col("model").isin(models)
    return messages.withColumn("next_model", following).where(own | ((F.col("role") == "user") & (F.col("model") == "") & F.col("next_model").isin(models))).drop("next_model")


def scope_stats(scoped: DataFrame) -> DataFrame:
    """Counts of a scoped message set by session."""
    n = lambda c, name: F.count_if(c).alias(name)
    return scoped.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), n(F.col("role") == "user", "user"), n(F.col("role") == "assistant", "assistant"), n(F.col("has_tool_use"), "tool_use"), n(F.col("has_thinking"), "thinking"), F.sum("output_tokens").alias("output_tokens"))


def list_filter(t: Tables, first: str, last: str, min_messages: int = 0, max_messages: int | None = None, starred: DataFrame | None = None) -> DataFrame:
    """Sessions whose span overlaps the dates, by size, starred ones only if a table of them is given."""
    out = visible(t.sessions, subagents=True).where((F.col("started_at") < F.expr(f"timestamp'{last}' + interval 1 day")) & (F.col("ended_at") >= F.expr(f"timestamp'{first}'")) & (F.col("message_count") >= min_messages))
    if max_messages is not None:
        out = out.where(F.col("message_count") <= max_messages)
    return out if starred is None else out.join(starred, "session_id", "left_semi")


def branch_pairs(sessions: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Sessions of any of the (project, branch) pairs; an empty list matches nothing."""
    wanted = sessions.sparkSession.createDataFrame(pairs, "project string, branch string")
    return sessions.join(wanted, ["project", "branch"], "left_semi")


def termination(sessions: DataFrame, now: str, flagged: Column) -> DataFrame:
    """Adds status: active within 10 minutes of `now`, stale within 60 if flagged, unclean if flagged and older, else clean."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("ended_at")
    return sessions.withColumn("status", F.when(age < 600_000_000, "active").when(flagged & (age < 3_600_000_000), "stale").when(flagged, "unclean").otherwise("clean"))


def is_system(content: Column) -> Column:
    """A user turn that the agent wrote: after reminder blocks and white space it begins with a known prefix."""
    bare = F.ltrim(F.regexp_replace(content, r"^\s*(?s)(<system-reminder>.*?</system-reminder>\s*)+", ""))
    out = F.lit(False)
    for prefix in SYSTEM_PREFIXES:
        out = out | bare.startswith(prefix)
    return out


#: What a goal's context begins with, and what counts as white space before a prefix.
GOAL = r"""^(<goal_context>|<codex_internal_context[^>]*\ssource\s*=\s*["']?goal["']?(\s[^>]*)?>)"""
BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*"


def system_row(content: Column, role: Column) -> Column:
    """A user turn that the agent wrote (F11): after white space and whole reminder blocks nothing is left, or it begins with a known prefix or a goal's tag."""
    bare = F.regexp_replace(content, f"^{BLANK}", "")
    rest = F.regexp_replace(bare, f"(?s)^(<system-reminder>.*?</system-reminder>{BLANK})+", "")
    hit = ((bare != "") & (rest == "")) | rest.rlike(GOAL)
    for prefix in SYSTEM_PREFIXES:
        hit = hit | rest.startswith(prefix)
    return (role == "user") & F.coalesce(hit, F.lit(False))


def contains_literal(text: Column, part: str) -> Column:
    """Case-insensitive substring without a pattern language."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def around(messages: DataFrame, anchors: DataFrame, before: int = 2, after: int = 2, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """For each anchor (session_id, anchor ordinal) the anchor and the next rows of the roles on both sides."""
    near = anchors.join(messages.where(F.col("role").isin(*roles)), "session_id")
    side = F.signum(F.col("ordinal") - F.col("anchor"))
    order = Window.partitionBy("session_id", "anchor", side).orderBy(F.abs(F.col("ordinal") - F.col("anchor")))
    near = near.withColumn("side", side).withColumn("turn", F.row_number().over(order)).where(((F.col("side") < 0) & (F.col("turn") <= before)) | ((F.col("side") > 0) & (F.col("turn") <= after)))
    own = anchors.join(messages, (anchors["session_id"] == messages["session_id"]) & (anchors["anchor"] == messages["ordinal"])).drop(anchors["session_id"])
    return near.select("session_id", "anchor", "ordinal", "role").unionByName(own.select("session_id", "anchor", "ordinal", "role"))
