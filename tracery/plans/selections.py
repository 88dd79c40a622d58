"""Queries of session selections, every clause at once and alone, with SQL oracles. What the lens lacks is planted on its sessions by their users' numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import selection
from ..operators.selection import Clauses
from ..sources.tables import Tables

NOW = "2024-01-28 23:00:00"
def u():
    return F.col("user_id")
ENDINGS = ["clean", "tool_call_pending", "truncated", "awaiting_user"]


def _pick(values: list[str], by: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u() / by) % len(values) + 1).cast("int"))


def sessions(t: Tables) -> DataFrame:
    """Some deleted, some without a start or an end, with outcomes, grades, failures, findings and how they ended."""
    return t.sessions.withColumns(
        {
            "created_at": F.col("started_at") - F.expr("interval 3 hours"),
            "started_at": F.when(u() % 8 != 3, F.col("started_at")),
            "ended_at": F.when(u() % 6 != 5, F.col("ended_at")),
            "deleted_at": F.when(u() % 17 == 16, F.col("ended_at")),
            "parent_id": F.when(u() % 10 == 9, "not-there").otherwise(F.col("parent_id")),
            "termination_status": F.when(u() % 9 != 8, _pick(ENDINGS, 2)),
            "outcome": F.when(u() % 7 != 6, _pick(["completed", "abandoned", "errored"], 3)),
            "health_grade": F.when(u() % 5 != 4, _pick(["A", "B", "C", "D", "F"], 1)),
            "tool_failures": (u() % 6).cast("long"),
            "secret_leaks": (u() % 3).cast("long"),
            "secrets_rules_version": F.when(u() % 4 != 1, (u() % 2 + 1).cast("string")),
        }
    )


_PICK = lambda values, by: "[" + ", ".join(f"'{v}'" for v in values) + f"][(user_id // {by}) % {len(values)} + 1]"
_S = f""", ss AS (SELECT * REPLACE (CASE WHEN user_id % 8 <> 3 THEN started_at END AS started_at, CASE WHEN user_id % 6 <> 5 THEN ended_at END AS ended_at, CASE WHEN user_id % 10 = 9 THEN 'not-there' ELSE parent_id END AS parent_id),
  started_at - INTERVAL 3 HOUR AS created_at, CASE WHEN user_id % 17 = 16 THEN ended_at END AS deleted_at, CASE WHEN user_id % 9 <> 8 THEN {_PICK(ENDINGS, 2)} END AS termination_status, CASE WHEN user_id % 7 <> 6 THEN {_PICK(["completed", "abandoned", "errored"], 3)} END AS outcome,
  CASE WHEN user_id % 5 <> 4 THEN {_PICK(["A", "B", "C", "D", "F"], 1)} END AS health_grade, user_id % 6 AS tool_failures, user_id % 3 AS secret_leaks, CASE WHEN user_id % 4 <> 1 THEN (user_id % 2 + 1)::VARCHAR END AS secrets_rules_version FROM sessions),
sv AS (SELECT *, coalesce(started_at, created_at) AS s, coalesce(ended_at, started_at, created_at) AS e, epoch(TIMESTAMP '{NOW}' - coalesce(ended_at, started_at, created_at)::TIMESTAMP) AS age FROM ss),
live AS (SELECT * FROM sv WHERE message_count > 0 AND deleted_at IS NULL)"""
_ROOTED = "relationship NOT IN ('subagent', 'fork')"
_ENDED = "(age < 600 OR (age >= 600 AND age < 3600 AND termination_status IN ('tool_call_pending', 'truncated')))"

#: A query for each clause: its name, clauses, whether it is a dashboard's (else a list's), and the same in SQL.
ONE_BY_ONE = {
    "dates": (Clauses(first="2024-01-05", last="2024-01-12"), False, "e >= TIMESTAMP '2024-01-05' AND s < TIMESTAMP '2024-01-13'"),
    "began": (Clauses(first="2024-01-05", last="2024-01-12", zone="America/New_York"), True, "s >= TIMESTAMP '2024-01-05 05:00:00' AND s < TIMESTAMP '2024-01-13 05:00:00'"),
    "since": (Clauses(active_since="2024-01-20 10:00:00"), False, "e >= TIMESTAMP '2024-01-20 10:00:00'"),
    "projects": (Clauses(not_project="p1", scope="automated"), True, "project <> 'p1' AND is_automated"),
    "places": (Clauses(machines=["h1", "h2"], agents=["a0", "a2"], branches=[("p1", "b1"), ("p2", "b0")]), False, "machine IN ('h1', 'h2') AND agent IN ('a0', 'a2') AND ((project = 'p1' AND branch = 'b1') OR (project = 'p2' AND branch = 'b0'))"),
    "no_branches": (Clauses(branches=[]), True, "false"),
    "models": (Clauses(models=["m1", "m2"], one_shots=False, min_user_messages=3), True, "session_id IN (SELECT session_id FROM messages WHERE model IN ('m1', 'm2')) AND (user_message_count > 1 OR is_automated) AND user_message_count >= 3"),
    "sizes": (Clauses(min_messages=3, max_messages=25, one_shots=False, scope="human"), False, "message_count BETWEEN 3 AND 25 AND NOT is_automated AND user_message_count > 1"),
    "outcomes": (Clauses(outcomes=["abandoned", "errored"], grades=["C", "D", "F"]), False, "outcome IN ('abandoned', 'errored') AND health_grade IN ('C', 'D', 'F')"),
    "failures": (Clauses(min_failures=4), True, "tool_failures >= 4"),
    "secrets": (Clauses(secrets=True), False, "secret_leaks > 0"),
    "secrets_by_rules": (Clauses(secrets=True, rules=["2"]), False, "secret_leaks > 0 AND secrets_rules_version IN ('2')"),
    "ended": (Clauses(ended=["active", "stale"]), False, _ENDED),
    "unclean": (Clauses(ended=["unclean", "no such"]), True, "age >= 3600 AND termination_status IN ('tool_call_pending', 'truncated')"),
    "waiting": (Clauses(ended=["awaiting_user", "clean"]), False, "termination_status IN ('awaiting_user', 'clean')"),
}


def _each(t: Tables) -> DataFrame:
    """clause, session_id for all of ONE_BY_ONE."""
    own, out = sessions(t), None
    for name, (f, is_dashboard, _) in ONE_BY_ONE.items():
        found = selection.dashboard(own, f, NOW, t.messages) if is_dashboard else selection.session_list(own, f, NOW)
        part = found.select(F.lit(name).alias("clause"), "session_id")
        out = part if out is None else out.unionByName(part)
    return out


EVERY = Clauses(first="2024-01-02", last="2024-01-27", active_since="2024-01-03", not_project="p4", machines=["h0", "h1", "h2", "h3"], agents=["a0", "a1"], min_messages=2, max_messages=200, min_user_messages=1, outcomes=["completed", "errored"], grades=["A", "B", "C"], min_failures=1, secrets=True, rules=["1", "2"], ended=["unclean", "awaiting_user", "clean"], scope="human", one_shots=False)
_EVERY = """e >= TIMESTAMP '2024-01-03' AND s < TIMESTAMP '2024-01-28' AND project <> 'p4' AND agent IN ('a0', 'a1') AND message_count BETWEEN 2 AND 200 AND outcome IN ('completed', 'errored') AND health_grade IN ('A', 'B', 'C') AND tool_failures >= 1
  AND secret_leaks > 0 AND secrets_rules_version IN ('1', '2') AND ((age >= 3600 AND termination_status IN ('tool_call_pending', 'truncated')) OR termination_status IN ('awaiting_user', 'clean')) AND NOT is_automated AND user_message_count > 1"""
_TREE = Clauses(first="2024-01-01", last="2024-01-09", scope="human", min_failures=1)


def _starred(t: Tables) -> DataFrame:
    return t.sessions.where("user_id % 4 <> 2").select("session_id")


QUERIES = {
    "select_each_clause": (_each, f"{_S} " + " UNION ALL ".join(f"SELECT '{n}' AS clause, session_id FROM live WHERE {_ROOTED} AND {sql}" for n, (_, _, sql) in ONE_BY_ONE.items())),
    "select_all_clauses": (lambda t: selection.session_list(sessions(t), EVERY, NOW, _starred(t)).select("session_id"), f"{_S} SELECT session_id FROM live WHERE {_ROOTED} AND user_id % 4 <> 2 AND {_EVERY}"),
    "select_subagents": (lambda t: selection.dashboard(sessions(t), Clauses(), NOW, subagents=True).select("session_id"), f"{_S} SELECT session_id FROM live WHERE relationship <> 'fork'"),
    "select_trees": (lambda t: selection.session_list(sessions(t), _TREE, NOW, children=True, orphans=True).select("session_id"), f"""{_S}, roots AS (SELECT session_id FROM live l WHERE NOT is_automated AND tool_failures >= 1 AND e >= TIMESTAMP '2024-01-01' AND s < TIMESTAMP '2024-01-10' AND (relationship NOT IN ('subagent', 'fork', 'continuation') OR NOT EXISTS (SELECT 1 FROM ss p WHERE p.session_id = l.parent_id))),
  tree AS (WITH RECURSIVE g(id) AS (SELECT session_id FROM roots UNION SELECT l.session_id FROM live l JOIN g ON l.parent_id = g.id WHERE NOT is_automated) SELECT id FROM g) SELECT id AS session_id FROM tree"""),
}
