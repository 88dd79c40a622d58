"""Edges of session selections that the given tables don't hold."""

from pyspark.sql import functions as F

from tracery.operators import selection
from tracery.operators.selection import Clauses

NOW = "2024-01-02 12:00:00"
COLUMNS = "session_id string, parent_id string, relationship string, project string, branch string, machine string, agent string, message_count long, user_message_count long, is_automated boolean, started_at string, ended_at string, created_at string, deleted_at string, termination_status string, outcome string, health_grade string, tool_failures long, secret_leaks long, secrets_rules_version string"
BASE = {"parent_id": None, "relationship": "", "project": "p", "branch": "b", "machine": "m", "agent": "a", "message_count": 5, "user_message_count": 2, "is_automated": False, "started_at": "2024-01-01 10:00:00", "ended_at": "2024-01-02 11:00:00", "created_at": "2024-01-01 09:00:00", "deleted_at": None, "termination_status": "clean", "outcome": None, "health_grade": None, "tool_failures": None, "secret_leaks": None, "secrets_rules_version": None}


def sessions(spark, *rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    df = spark.createDataFrame([tuple((BASE | r)[n] for n in names) for r in rows], COLUMNS)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "ended_at", "created_at", "deleted_at")})


def ids(df):
    return sorted(r.session_id for r in df.collect())


def test_bounds_of_how_sessions_ended(spark):
    df = sessions(spark, *({"session_id": f"{s}{m}", "ended_at": f"2024-01-02 {t}", "termination_status": s} for s in ("truncated", "clean", None) for m, t in ((9, "11:50:01"), (10, "11:50:00"), (59, "11:00:01"), (60, "11:00:00"))))
    own = lambda *kinds: ids(df.where(selection.ended_as(list(kinds), NOW)))
    assert own("active") == ["None9", "clean9", "truncated9"] and own("stale") == ["truncated10", "truncated59"] and own("unclean") == ["truncated60"]
    assert own("clean") == ["clean10", "clean59", "clean60", "clean9"] and len(own()) == len(own("other")) == 12 and own("stale", "unclean", "other") == ["truncated10", "truncated59", "truncated60"]


def test_nulls_and_days_of_a_zone(spark):
    df = sessions(spark, {"session_id": "none", "started_at": None, "ended_at": None, "created_at": None}, {"session_id": "made", "started_at": None, "ended_at": None, "created_at": "2024-01-01 04:59:59"}, {"session_id": "later", "started_at": "2024-01-01 05:00:00"}, {"session_id": "gone", "deleted_at": "2024-01-01 00:00:00"}, {"session_id": "empty", "message_count": 0})
    day = Clauses(first="2023-12-31", last="2023-12-31", zone="America/New_York")
    assert ids(selection.dashboard(df, day, NOW)) == ["made"] and ids(selection.dashboard(df, Clauses(), NOW)) == ["later", "made", "none"]
    assert ids(selection.session_list(df, Clauses(first="2024-01-02"), NOW)) == ["later"]
    assert ids(selection.session_list(df, Clauses(outcomes=["x"]), NOW)) == ids(selection.session_list(df, Clauses(secrets=True), NOW)) == ids(selection.session_list(df, Clauses(min_failures=0), NOW)) == []


def test_trees_stop_where_a_session_is_hidden(spark):
    df = sessions(
        spark,
        {"session_id": "r", "project": "q"}, {"session_id": "r1", "parent_id": "r", "relationship": "subagent"}, {"session_id": "r2", "parent_id": "r1", "relationship": "fork"},
        {"session_id": "rd", "parent_id": "r", "relationship": "fork", "deleted_at": "2024-01-01 00:00:00"}, {"session_id": "rd1", "parent_id": "rd", "relationship": "subagent"},
        {"session_id": "ra", "parent_id": "r", "relationship": "subagent", "is_automated": True}, {"session_id": "ra1", "parent_id": "ra", "relationship": "subagent"},
        {"session_id": "other"}, {"session_id": "o1", "parent_id": "other", "relationship": "subagent", "project": "q"},
        {"session_id": "lost", "parent_id": "nowhere", "relationship": "subagent", "project": "q"}, {"session_id": "lost1", "parent_id": "lost", "relationship": "continuation"},
    )
    f = Clauses(project="q", scope="human")
    tree = lambda **kw: ids(selection.session_list(df, f, NOW, children=True, **kw))
    assert tree() == ["r", "r1", "r2"] and tree(orphans=True) == ["lost", "lost1", "r", "r1", "r2"]
    assert ids(selection.session_list(df, f, NOW)) == ["r"]
    starred = spark.createDataFrame([("other",), ("r1",)], "session_id string")
    assert ids(selection.session_list(df, Clauses(), NOW, starred, children=True)) == ["o1", "other"]
    assert ids(selection.session_list(df.limit(0), f, NOW, children=True)) == []
