"""Which sessions a page shows: one set of clauses for dashboards (F1), session lists (F6) and how sessions ended."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import automation, not_one_shot
from .graph import tops

#: A session counts as active for so long after its last activity, and as stale for so long (seconds).
ACTIVE, STALE = 600, 3600
#: How a session ended if something was left open.
OPEN = ["tool_call_pending", "truncated"]
#: Relationships of sessions that are shown below another one.
CHILDREN = ["subagent", "fork"]
#: Relationships of sessions that belong to the tree of their parent.
LINKED = ["subagent", "fork", "continuation"]


class Clauses(NamedTuple):
    """What is asked of a session; a clause that is left at its default asks nothing.

    first, last: local dates in `zone`. branches: pairs of project and branch; an empty list matches nothing. ended: any of active, stale, unclean, clean,
    awaiting_user. secrets: whether secrets were found, by `rules` (versions) if they are given. scope: human, automated or all.
    """

    first: str | None = None
    last: str | None = None
    zone: str = "UTC"
    active_since: str | None = None
    project: str | None = None
    not_project: str | None = None
    machines: list[str] | None = None
    agents: list[str] | None = None
    branches: list[tuple[str, str]] | None = None
    models: list[str] | None = None
    min_messages: int = 0
    max_messages: int | None = None
    min_user_messages: int = 0
    outcomes: list[str] | None = None
    grades: list[str] | None = None
    min_failures: int | None = None
    secrets: bool = False
    rules: list[str] | None = None
    ended: list[str] | None = None
    scope: str = "all"
    one_shots: bool = True


def started() -> Column:
    return F.coalesce("started_at", "created_at")


def last_active() -> Column:
    return F.coalesce("ended_at", "started_at", "created_at")


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def ended_as(kinds: list[str], now: str) -> Column:
    """Whether a session is of any of the kinds at an instant (F10). Kinds that there aren't ask nothing; neither does a list of none."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(last_active())
    left_open = F.col("termination_status").isin(OPEN)
    tests = {
        "active": age < ACTIVE * 1_000_000,
        "stale": (age < STALE * 1_000_000) & (age >= ACTIVE * 1_000_000) & left_open,
        "unclean": (age >= STALE * 1_000_000) & left_open,
        "clean": F.col("termination_status") == "clean",
        "awaiting_user": F.col("termination_status") == "awaiting_user",
    }
    own = [tests[k] for k in kinds if k in tests]
    return any_of(own) if own else F.lit(True)


def edge(date: str, zone: str, days: int = 0) -> Column:
    """The instant at which a local date begins, or so many days later."""
    return F.to_utc_timestamp(F.date_add(F.lit(date).cast("date"), days).cast("timestamp"), zone)


def clauses(f: Clauses, now: str) -> Column:
    """All but dates, models and one-shots."""
    c, tests = F.col, [automation(f.scope)]
    if f.project is not None:
        tests.append(c("project") == f.project)
    if f.not_project is not None:
        tests.append(c("project") != f.not_project)
    if f.machines is not None:
        tests.append(c("machine").isin(f.machines))
    if f.agents is not None:
        tests.append(c("agent").isin(f.agents))
    if f.branches is not None:
        tests.append(any_of([(c("project") == p) & (c("branch") == b) for p, b in f.branches]))
    if f.active_since is not None:
        tests.append(last_active() >= F.lit(f.active_since).cast("timestamp"))
    if f.min_messages:
        tests.append(c("message_count") >= f.min_messages)
    if f.max_messages is not None:
        tests.append(c("message_count") <= f.max_messages)
    if f.min_user_messages:
        tests.append(c("user_message_count") >= f.min_user_messages)
    if f.outcomes is not None:
        tests.append(c("outcome").isin(f.outcomes))
    if f.grades is not None:
        tests.append(c("health_grade").isin(f.grades))
    if f.min_failures is not None:
        tests.append(c("tool_failures") >= f.min_failures)
    if f.secrets:
        tests.append(c("secret_leaks") > 0)
        if f.rules:
            tests.append(c("secrets_rules_version").isin(f.rules))
    if f.ended is not None:
        tests.append(ended_as(f.ended, now))
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def shown(sessions: DataFrame) -> DataFrame:
    """Sessions with messages that aren't deleted."""
    return sessions.where((F.col("message_count") > 0) & F.col("deleted_at").isNull())


def dashboard(sessions: DataFrame, f: Clauses, now: str, messages: DataFrame | None = None, subagents: bool = False) -> DataFrame:
    """The sessions that dashboards count (F1): those that began on the dates; forks never, subagents only if asked for. messages are needed for models only."""
    out = shown(sessions).where(clauses(f, now)).where((F.col("relationship") != "fork") & (F.lit(subagents) | (F.col("relationship") != "subagent")))
    if f.first is not None:
        out = out.where(started() >= edge(f.first, f.zone))
    if f.last is not None:
        out = out.where(started() < edge(f.last, f.zone, 1))
    if not f.one_shots:
        out = out.where(not_one_shot(f.scope))
    if f.models is not None:
        out = out.join(messages.where(F.col("model").isin(f.models)).select("session_id"), "session_id", "left_semi")
    return out


def listed(sessions: DataFrame, f: Clauses, now: str, starred: DataFrame | None = None) -> DataFrame:
    """The sessions that meet all clauses of a list (F6): those whose span meets the dates; of a table of starred ones, if given, those in it."""
    out = sessions.where(clauses(f, now))
    if f.first is not None:
        out = out.where(last_active() >= edge(f.first, f.zone))
    if f.last is not None:
        out = out.where(started() < edge(f.last, f.zone, 1))
    if not f.one_shots:
        out = out.where(not_one_shot(f.scope))
    return out if starred is None else out.join(starred.select("session_id"), "session_id", "left_semi")


def session_list(sessions: DataFrame, f: Clauses, now: str, starred: DataFrame | None = None, children: bool = False, orphans: bool = False) -> DataFrame:
    """The sessions of a list (F6). Without children, those that are no child of another and meet the clauses.

    With children, whole trees whose root meets them: below it only visible sessions of the automation scope, and nothing below one that is not.
    A root isn't linked to another session or, with `orphans`, to one that isn't there. Trees are followed by doubling pointers.
    """
    every = shown(sessions)
    if not children:
        return listed(every.where(~F.col("relationship").isin(CHILDREN)), f, now, starred)
    there = sessions.select(F.col("session_id").alias("parent_id"), F.lit(True).alias("has_parent"))
    lost = sessions.join(there, "parent_id", "left").where(~F.col("relationship").isin(LINKED) | (F.lit(orphans) & F.col("has_parent").isNull()))
    roots = listed(shown(lost.select(*sessions.columns)), f, now, starred).select(F.col("session_id").alias("root"))
    below = every.where(automation(f.scope)).select(F.col("session_id").alias("id"), F.nullif("parent_id", F.lit("")).alias("parent_id"))
    # A root stands for itself; a session whose parent was left out heads a tree that no root has.
    free = below.join(roots.select(F.col("root").alias("id"), F.lit(True).alias("is_root")), "id", "left").select("id", F.when(F.col("is_root").isNull(), F.col("parent_id")).alias("parent_id"))
    inside = tops(free).select(F.col("id").alias("session_id"), "root").join(roots, "root", "left_semi")
    return every.join(inside.select("session_id"), "session_id", "left_semi")
