"""Queries of the ingest family: transcripts are written from the text sessions, then read as an archive's files would be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources.tables import Tables


def _tree_lines(t: Tables) -> DataFrame:
    """The text sessions as lines of the uuid-tree format, with a line of another type in each file."""
    model = F.when(F.col("role") == "assistant", F.concat(F.lit("m"), (F.col("ordinal") % 3).cast("string")))
    line = F.to_json(F.struct(F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("type"), F.concat_ws("-", "session_id", "ordinal").alias("uuid"), (F.col("role") == "system").alias("isMeta"), F.lit("2024-01-02T03:04:05Z").alias("timestamp"), F.struct("role", "content", model.alias("model"), F.struct(F.length("content").alias("output_tokens")).alias("usage")).alias("message")))
    rows = t.turns.select(F.col("session_id").cast("string").alias("file"), (F.col("ordinal") + 1).alias("line_no"), line.alias("value"))
    return rows.unionByName(rows.select("file").distinct().select("file", F.lit(0).cast("long").alias("line_no"), F.lit('{"type":"summary"}').alias("value")))


def _log_lines(t: Tables) -> DataFrame:
    """The text sessions as an event log: a turn_context before every third turn, a token_count after assistants."""
    kinds = F.array_compact(F.array(F.when(F.col("ordinal") % 3 == 0, F.lit("turn_context")), F.lit("response_item"), F.when(F.col("role") == "assistant", F.lit("token_count"))))
    rows = t.turns.select("session_id", "ordinal", "role", "content", F.posexplode(kinds).alias("i", "type"))
    payload = F.struct(F.when(F.col("type") == "turn_context", F.concat(F.lit("m"), F.col("ordinal").cast("string"))).alias("model"), F.when(F.col("type") == "response_item", F.col("role")).alias("role"), F.when(F.col("type") == "response_item", F.col("content")).alias("text"), F.when(F.col("type") == "token_count", F.length("content")).alias("output_tokens"))
    return rows.select(F.col("session_id").cast("string").alias("file"), (F.col("ordinal") * 4 + F.col("i")).alias("line_no"), F.to_json(F.struct("type", payload.alias("payload"))).alias("value"))


def _forks(t: Tables) -> DataFrame:
    """A turn's parent is the one before, but for each sixth, which goes back three turns."""
    rows = t.messages.select("session_id", "ordinal", "role")
    parent = F.when(F.col("ordinal") % 6 == 5, F.col("ordinal") - 3).when(F.col("ordinal") > 0, F.col("ordinal") - 1)
    name = lambda o: F.when(o.isNotNull(), F.concat_ws("/", F.col("session_id"), o.cast("string")))
    return ingest.forks(rows.select("session_id", name(F.col("ordinal")).alias("id"), name(parent).alias("parent_id"), "role", F.col("ordinal").alias("place")), tree="session_id")


def _conversations(t: Tables) -> DataFrame:
    """Each session as a tree: a root without a message, a turn below the one before, and beside each fifth turn an answer that was made before it."""
    rows = t.turns.select(F.col("session_id").alias("conversation"), F.col("ordinal").cast("string").alias("id"), F.when(F.col("ordinal") > 0, (F.col("ordinal") - 1).cast("string")).otherwise("root").alias("parent_id"), "role", F.col("content").alias("text"))
    other = rows.where("cast(id as long) % 5 = 3").select("conversation", F.concat("id", F.lit("-old")).alias("id"), "parent_id", "role", F.lit("an answer that was made anew").alias("text"))
    none = F.lit(None).cast("string")
    roots = rows.select("conversation").distinct().select("conversation", F.lit("root").alias("id"), none.alias("parent_id"), none.alias("role"), none.alias("text"))
    leaves = t.turns.groupBy(F.col("session_id").alias("conversation")).agg(F.max("ordinal").cast("string").alias("id"))
    return ingest.conversation_path(rows.unionByName(other).unionByName(roots), leaves)


def _endings(t: Tables) -> DataFrame:
    """Calls of each third assistant turn; results two turns later for some; stop reasons by number."""
    s, o = F.col("session_id"), F.col("ordinal")
    messages = t.turns.select("session_id", "ordinal", "role", "is_system", F.when((s + o) % 3 == 0, "end_turn").when((s + o) % 3 == 1, "task_complete").alias("stop_reason"), (s % 11 == 5).alias("truncated"))
    calls = t.turns.where("role = 'assistant' and (session_id + ordinal) % 3 <> 1").select("session_id", "ordinal", F.concat(F.lit("c"), (o % 4).cast("string")).alias("call_id"))
    results = calls.where("session_id % 2 = 0").select("session_id", (o + 1).alias("ordinal"), "call_id").unionByName(calls.select("session_id", (o - 1).alias("ordinal"), "call_id"))
    return ingest.termination_status(messages, calls, results)


_CATEGORY = "CASE " + " ".join(f"WHEN n IN ({', '.join(repr(x) for x in names)}) THEN '{c}'" for c, names in ingest.CATEGORIES.items()) + " ELSE 'Other' END"
_AUTO = ", f AS (SELECT session_id, count(*) AS n, arg_min(content, ordinal) AS c FROM turns WHERE role = 'user' AND NOT is_system GROUP BY 1)"

#: First prompts of planted sessions: each automated pattern's beginning, parts of others, whole ones with blanks, and near misses.
PROMPTS = [
    "You are a code reviewer. Look", "You are a security code reviewer. x", "You are a design reviewer.", "You are a code assistant. Your task is to address all", "You are a code review insights analyst.",
    "You are reviewing whether an implementation matches", "You are a plan document reviewer.", "You are a spec document reviewer.", "You are summarizing a day of AI agent activity.", "You are analyzing AI agent sessions.",
    "## Analysis Request", "# Fix Request", "You are a helpful assistant working on a software project.", "You are combining multiple code review outputs into a single GitHub PR comment.", "You are generating a changelog",
    "<user_action>", "Review the code changes introduced by commit 1", "Review the code changes in commit 2", "Implement the following plan: a",
    "So: You are a conversation title generator", "Hm. You are a security code reviewer with an exploitability burden of proof. Review the code changes for concrete vulnerabilities!", " Warmup ", "Respond with exactly: OK", "Reply with exactly OK.",
    " You are a code reviewer.", "you are a code reviewer.", "Warmup now", "A plain question", "  ", "Review the code changes",
]


def _prompted(t: Tables) -> DataFrame:
    """Sessions of one prompt each, but for each tenth, which has two."""
    s = F.col("session_id")
    first = t.turns.where("ordinal = 0").select("session_id", F.lit(0).alias("ordinal"), F.element_at(F.array(*map(F.lit, PROMPTS)), (s % len(PROMPTS) + 1).cast("int")).alias("content"))
    more = first.where("session_id % 10 = 7").select("session_id", F.lit(2).alias("ordinal"), F.lit("and then?").alias("content"))
    return ingest.automated(first.unionByName(more).withColumns({"role": F.lit("user"), "is_system": F.lit(False)}))


LENS_QUERIES = {
    "ingest_automated_prompts": (_prompted, f" SELECT session_id, session_id % {len(PROMPTS)} < 24 AND session_id % 10 <> 7 AS is_automated FROM turns WHERE ordinal = 0"),
    "ingest_conversation_paths": (_conversations, " SELECT session_id AS conversation, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS ordinal, role, content AS text FROM turns WHERE content <> '' AND role IN ('user', 'assistant', 'system')"),
    "ingest_termination_status": (_endings, ", o AS (SELECT session_id, arg_max(role, ordinal) FILTER (NOT is_system) AS r, max(ordinal) FILTER (NOT is_system) AS l, max(ordinal) FILTER (NOT is_system AND role = 'assistant') AS a FROM turns GROUP BY 1) SELECT session_id, CASE WHEN session_id % 11 = 5 THEN 'truncated' WHEN a IS NOT NULL AND (session_id + a) % 3 <> 1 AND session_id % 2 = 1 THEN 'tool_call_pending' WHEN r = 'assistant' AND (session_id + l) % 3 < 2 THEN 'awaiting_user' ELSE 'clean' END AS termination FROM o"),
    "ingest_uuid_tree": (lambda t: ingest.uuid_tree(_tree_lines(t)).select("file", "ordinal", "role", "content", "model", "is_system", "uuid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "output_tokens"), " SELECT session_id::VARCHAR AS file, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS ordinal, role, content, CASE WHEN role = 'assistant' THEN 'm' || ordinal % 3 ELSE '' END AS model, is_system, session_id || '-' || ordinal AS uuid, '2024-01-02 03:04:05' AS ts, length(content) AS output_tokens FROM turns"),
    "ingest_event_log": (lambda t: ingest.event_log(_log_lines(t)), " SELECT session_id::VARCHAR AS file, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS ordinal, role, content, CASE WHEN role = 'assistant' THEN coalesce('m' || last_value(CASE WHEN ordinal % 3 = 0 THEN ordinal END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ordinal), '') ELSE '' END AS model, CASE WHEN role = 'assistant' THEN length(content) ELSE 0 END AS output_tokens FROM turns"),
    "ingest_unchanged": (lambda t: ingest.unchanged(t.turns.select(F.concat_ws("-", "session_id", "ordinal").alias("key"), F.col("content").alias("text")), t.turns.where("session_id % 2 = 0").select(F.concat_ws("-", "session_id", "ordinal").alias("key"), F.sha2(F.when(F.col("ordinal") == 1, F.lit("old")).otherwise(F.col("content")).cast("binary"), 256).alias("hash"))).select("key"), " SELECT session_id || '-' || ordinal AS key FROM turns WHERE session_id % 2 <> 0 OR ordinal = 1"),
    "ingest_changed_files": (lambda t: ingest.changed_files(t.sessions.select(F.col("session_id").alias("path"), F.col("message_count").alias("size"), F.col("ended_at").alias("modified")), t.sessions.where("user_id % 3 <> 0").select(F.col("session_id").alias("path"), (F.col("message_count") + (F.col("user_id") % 5 == 0).cast("int")).alias("size"), F.col("ended_at").alias("modified"))).select("path"), " SELECT session_id AS path FROM sessions WHERE user_id % 3 = 0 OR user_id % 5 = 0"),
    "ingest_sanitized": (lambda t: ingest.sanitized(t.messages.select("session_id", "ordinal", F.when(F.col("event_id") % 31 == 0, "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("event_id") % 17 == 0, F.lit("1970-01-01").cast("timestamp")).otherwise(F.col("ts")).alias("ts"), F.when(F.col("event_id") % 13 == 0, F.lit(-5)).when(F.col("event_id") % 19 == 0, F.lit(9_000_000)).otherwise(F.col("output_tokens")).alias("output_tokens"), F.when(F.col("event_id") % 7 == 0, F.lit("a\x01b")).otherwise("plain").alias("content"))).select("session_id", "ordinal", "output_tokens", "content", "clamped", "blanked", "cleaned"), " SELECT session_id, ordinal, CASE WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 19 = 0 THEN 2000000 ELSE output_tokens END AS output_tokens, CASE WHEN event_id % 7 = 0 THEN 'ab' ELSE 'plain' END AS content, event_id % 13 = 0 OR event_id % 19 = 0 AS clamped, event_id % 17 = 0 AS blanked, event_id % 7 = 0 AS cleaned FROM messages WHERE event_id % 31 <> 0"),
    "ingest_categories": (lambda t: t.calls.groupBy(ingest.category(F.when(F.col("call_index") % 2 == 0, F.lower("category")).otherwise(F.col("tool_name"))).alias("kind")).agg(F.count(F.lit(1)).alias("calls")), f" SELECT {_CATEGORY} AS kind, count(*) AS calls FROM (SELECT CASE WHEN call_index % 2 = 0 THEN lower(category) ELSE tool_name END AS n FROM calls) GROUP BY 1"),
    "ingest_skills": (lambda t: t.calls.select("session_id", "call_index", ingest.skill(F.concat(F.lit("cat /home/x/"), "skill", F.when(F.col("call_index") % 2 == 0, "/SKILL.md").otherwise("/README"))).alias("found")), " SELECT session_id, call_index, CASE WHEN skill <> '' AND call_index % 2 = 0 THEN skill END AS found FROM calls"),
    "ingest_projects": (lambda t: t.sessions.select("session_id", ingest.project(F.concat(F.lit("/w/"), "project", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("-fix-"), "branch")).otherwise("/")), F.concat(F.lit("fix/"), "branch")).alias("name")), " SELECT session_id, project AS name FROM sessions"),
    "ingest_terminations": (lambda t: ingest.terminations(t.messages.withColumn("truncated", F.col("event_id") % 11 == 0)), " SELECT session_id, CASE WHEN event_id % 11 = 0 THEN 'truncated' WHEN role = 'assistant' AND has_tool_use THEN 'tool_call_pending' WHEN role = 'assistant' THEN 'awaiting_user' ELSE 'clean' END AS termination FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ordinal DESC) = 1"),
    "ingest_forks": (_forks, None),
    "ingest_subagents": (ingest.linked, " SELECT s.session_id, s.parent_id, p.message_count AS parent_messages FROM sessions s JOIN sessions p ON p.session_id = s.parent_id WHERE s.relationship = 'subagent'"),
    "ingest_automated": (lambda t: ingest.automated(t.turns, ["The", "E", "Un"]), f"{_AUTO} SELECT session_id, n = 1 AND (starts_with(c, 'The') OR starts_with(c, 'E') OR starts_with(c, 'Un')) AS is_automated FROM f"),
    "ingest_audit": (lambda t: ingest.audit(ingest.automated(t.turns, ["The", "E"]), ingest.automated(t.turns, ["T"])), f"{_AUTO} SELECT session_id, n = 1 AND (starts_with(c, 'The') OR starts_with(c, 'E')) AS is_automated, n = 1 AND starts_with(c, 'T') AS was FROM f WHERE n = 1 AND (starts_with(c, 'The') OR starts_with(c, 'E')) <> starts_with(c, 'T')"),
}
