"""Queries of the maintenance, export and streaming families, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.storage import folder_for
from ..operators import maintain
from ..sources.tables import Tables, lens
from ..streaming import jobs, mirror, transcripts
from . import intake

_ROW = "ordinal || '|' || role || '|' || model || '|' || content_length || '|' || output_tokens || '|' || message_id || '|' || request_id"
_PRINT = lambda src: f"(SELECT session_id, sha256(session_id || ':' || count(*) || ':' || sum(('0x' || substr(sha256({_ROW}), 1, 12))::BIGINT)) AS fingerprint FROM {src} GROUP BY 1)"
_OLD = "(SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN output_tokens + 1 ELSE output_tokens END AS output_tokens) FROM messages WHERE user_id % 11 <> 0)"


def _old(t: Tables):
    return t.messages.where("user_id % 11 <> 0").withColumn("output_tokens", F.when(F.col("event_id") % 97 == 0, F.col("output_tokens") + 1).otherwise(F.col("output_tokens")))


def _new(t: Tables):
    return t.messages.where("user_id % 13 <> 0")


def _newer_half(t: Tables):
    """The last row of each session from after the middle of the journal's revisions through its last."""
    least, most = t.messages.agg(F.min("event_id"), F.max("event_id")).first()
    return maintain.latest(t.messages.select("session_id", "event_id", "event_type"), "session_id", "event_id", ((least or 0) + (most or 0)) // 2, most or 0)


def _archive(t: Tables):
    """Text sessions with their turns, the calls of the order with their number, failed calls as findings, each ninth turn as a pin, and the usage of the user with their number."""
    own = t.turns.select("session_id").distinct()
    calls = t.calls.join(own, "session_id", "left_semi")
    usage = t.messages.where("role = 'assistant'").select(F.col("user_id").alias("session_id"), "event_id", "model", "output_tokens").join(own, "session_id", "left_semi")
    return maintain.archive_fingerprints(
        {
            "messages": (t.turns, ["ordinal", "role", "content"]),
            "usage": (usage, ["event_id", "model", "output_tokens"]),
            "calls": (calls, ["call_index", "tool_name", "input"]),
            "findings": (calls.where("failed"), ["call_index", "category"]),
            "pins": (t.turns.where("(session_id + ordinal) % 9 = 0"), ["ordinal"]),
        }
    )


_PART = lambda name, fields: f"('0x' || substr(sha256('{name}|' || {fields}), 1, 12))::BIGINT AS v"
_ARCHIVE = f""", own AS (SELECT DISTINCT session_id FROM turns), parts AS (
  SELECT session_id, {_PART("messages", "ordinal || '|' || role || '|' || coalesce(content, '-')")} FROM turns
  UNION ALL SELECT user_id, {_PART("usage", "event_id || '|' || model || '|' || output_tokens")} FROM messages WHERE role = 'assistant' AND user_id IN (FROM own)
  UNION ALL SELECT session_id, {_PART("calls", "call_index || '|' || tool_name || '|' || input")} FROM calls WHERE session_id IN (FROM own)
  UNION ALL SELECT session_id, {_PART("findings", "call_index || '|' || category")} FROM calls WHERE failed AND session_id IN (FROM own)
  UNION ALL SELECT session_id, {_PART("pins", "ordinal")} FROM turns WHERE (session_id + ordinal) % 9 = 0)
  SELECT session_id::VARCHAR AS session_id, sha256(session_id || ':' || count(*) || ':' || sum(v)) AS fingerprint FROM parts GROUP BY session_id"""


def _archive_diff(t: Tables):
    calls = ["session_id", "call_index", "tool_name", "input"]
    return maintain.archive_diff(
        {
            "messages": (_old(t), _new(t), ["session_id", "ordinal", "role", "output_tokens"]),
            "calls": (t.calls.where("session_id % 5 <> 0"), t.calls.where("call_index <> 3"), calls),
            "tools": (t.calls.where("session_id % 3 = 0"), t.calls.where("session_id % 4 = 0"), ["tool_name", "input"]),  # many equal rows
        }
    )


_SIDES = {
    "messages": (_OLD, "messages WHERE user_id % 13 <> 0", "session_id, ordinal, role, output_tokens"),
    "calls": ("calls WHERE session_id % 5 <> 0", "calls WHERE call_index <> 3", "session_id, call_index, tool_name, input"),
    "tools": ("calls WHERE session_id % 3 = 0", "calls WHERE session_id % 4 = 0", "tool_name, input"),
}
_DIFF = " UNION ALL ".join(f"SELECT '{n}' AS \"table\", (SELECT count(*) FROM (SELECT {c} FROM {b} EXCEPT ALL SELECT {c} FROM {a})) AS added, (SELECT count(*) FROM (SELECT {c} FROM {a} EXCEPT ALL SELECT {c} FROM {b})) AS removed, (SELECT count(*) FROM (SELECT {c} FROM {a} INTERSECT ALL SELECT {c} FROM {b})) AS rows" for n, (a, b, c) in _SIDES.items())

LENS_QUERIES = {
    "upkeep_archive_diff": (_archive_diff, f" {_DIFF}"),
    "upkeep_archive_fingerprints": (_archive, _ARCHIVE),
    "upkeep_fingerprints": (lambda t: maintain.fingerprints(t.messages), f" SELECT * FROM {_PRINT('messages')}"),
    "upkeep_changed": (lambda t: maintain.changed(maintain.fingerprints(_new(t)), maintain.fingerprints(_old(t))), f", a AS {_PRINT('(SELECT * FROM messages WHERE user_id % 13 <> 0)')}, b AS {_PRINT(_OLD)} SELECT session_id, CASE WHEN b.fingerprint IS NULL THEN 'new' WHEN a.fingerprint IS NULL THEN 'gone' ELSE 'changed' END AS change FROM a FULL JOIN b USING (session_id) WHERE a.fingerprint IS DISTINCT FROM b.fingerprint"),
    "upkeep_diff_plan": (lambda t: maintain.diff_plan(_old(t).where("ordinal % 9 <> 8"), t.messages.where("event_id % 53 <> 0")), f", a AS (SELECT session_id, ordinal, {_ROW.partition(' || ')[2].partition(' || ')[2]} AS x FROM {_OLD} WHERE ordinal % 9 <> 8), b AS (SELECT session_id, ordinal, {_ROW.partition(' || ')[2].partition(' || ')[2]} AS y FROM messages WHERE event_id % 53 <> 0), c AS (SELECT session_id, count(*) FILTER (x IS NULL) AS added, count(*) FILTER (y IS NULL) AS missing, count(*) FILTER (x <> y) AS updated, count(x) AS stored FROM a FULL JOIN b USING (session_id, ordinal) GROUP BY 1) SELECT session_id, added, updated, CASE WHEN missing > 0 OR updated * 2 > stored THEN 'replace' WHEN updated > 0 THEN 'update' WHEN added > 0 THEN 'append' ELSE 'none' END AS plan FROM c"),
    "upkeep_multiset_diff": (lambda t: maintain.multiset_diff(_old(t), t.messages, ["session_id", "model", "output_tokens"]), f", a AS (SELECT session_id, model, output_tokens, count(*) AS l FROM {_OLD} GROUP BY ALL), b AS (SELECT session_id, model, output_tokens, count(*) AS r FROM messages GROUP BY ALL) SELECT session_id, model, output_tokens, coalesce(l, 0) AS \"left\", coalesce(r, 0) AS \"right\" FROM a FULL JOIN b USING (session_id, model, output_tokens) WHERE l IS DISTINCT FROM r"),
    "upkeep_carry_over": (lambda t: maintain.carry_over(t.sessions.where("user_id % 2 = 0"), t.sessions.where("user_id % 3 = 0"), "session_id").select("session_id"), " SELECT session_id FROM sessions WHERE user_id % 3 = 0 OR user_id % 2 = 0"),
    "upkeep_latest": (lambda t: maintain.latest(t.messages.select("session_id", "event_id", "event_type"), "session_id", "event_id", 100, 900), " SELECT session_id, event_id, event_type FROM messages WHERE event_id > 100 AND event_id <= 900 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) = 1"),
    "upkeep_latest_half": (_newer_half, " SELECT session_id, event_id, event_type FROM messages WHERE event_id > (SELECT (min(event_id) + max(event_id)) // 2 FROM messages) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) = 1"),
    "upkeep_merge_origins": (lambda t: maintain.merge_origins({"x": t.messages.where("user_id % 2 = 0").select("session_id", "event_id"), "y": t.messages.select("session_id", "event_id")}, "session_id", "event_id"), " SELECT 'x~' || session_id AS session_id, max(event_id) AS event_id FROM messages WHERE user_id % 2 = 0 GROUP BY 1 UNION ALL SELECT 'y~' || session_id, max(event_id) FROM messages GROUP BY 1"),
    "export_sessions": (maintain.session_export, ", b AS (SELECT session_id, count(DISTINCT model) AS models, sum(output_tokens)::BIGINT AS o FROM messages WHERE model <> '' GROUP BY 1) SELECT session_id, project, agent, message_count, epoch_us(ended_at) - epoch_us(started_at) AS micros, coalesce(models, 0) AS models, coalesce(o, 0) AS output_tokens FROM sessions LEFT JOIN b USING (session_id)"),
    "export_reporting_day": (maintain.reporting_day, ", h AS (SELECT x AS hour, count(m.ts) AS messages, count(DISTINCT session_id) AS sessions, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens FROM range(24) r(x) LEFT JOIN (SELECT * FROM messages WHERE ts::DATE = DATE '2024-01-10') m ON hour(m.ts) = x GROUP BY 1) SELECT *, sha256(hour || '|' || messages || '|' || sessions || '|' || output_tokens) AS digest FROM h"),
}


def _stream(operator, mode: str):
    return lambda spark, sf_dir: jobs.run_to_end(operator(jobs.events_stream(spark, sf_dir)), mode)


def _transcripts(spark, sf_dir: str):
    """The text sessions as transcripts of fifty each, in segments of which each repeats the two lines before it, read as a stream of several batches."""
    folder = folder_for(spark)
    turns = lens(spark, sf_dir).turns
    order = Window.partitionBy("transcript").orderBy("session_id", "ordinal")
    own = turns.withColumn("transcript", F.expr("session_id div 50"))
    named = own.select(F.col("transcript").alias("session_id"), (F.row_number().over(order) - 1).alias("ordinal"), "role", "content")
    transcripts.written_in_segments(intake._tree_lines(Tables(None, None, None, named)), f"{folder}/lines", bytes_each=1 << 16, again=2)
    files = spark.read.format("binaryFile").load(f"{folder}/lines/*/*").count()
    found = jobs.run_to_end(transcripts.uuid_tree(transcripts.lines_stream(spark, f"{folder}/lines", max(1, files // 3 + 1))), "append")
    return found.select("file", "ordinal", "role", "content", "model", "is_system", "uuid", "output_tokens")


def _mirror(spark, sf_dir: str):
    """A mirror of all sessions but automated ones and each eleventh user's, which are deleted."""
    folder = folder_for(spark)
    stream = jobs.events_stream(spark, sf_dir)
    deleted = lambda: spark.read.parquet(f"{folder}/deleted")
    lens(spark, sf_dir).sessions.where("user_id % 11 = 3").select("session_id").write.parquet(f"{folder}/deleted")
    mirror.keep(stream, f"{folder}/mirror", f"{folder}/state", "event_id", _MIRRORED, ~F.col("is_automated"), deleted).awaitTermination()
    prints = spark.read.parquet(f"{folder}/mirror/fingerprints").select("session_id", "fingerprint")
    rows = spark.read.parquet(f"{folder}/mirror/messages")
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("output_tokens").alias("output_tokens")).join(prints, "session_id")


_MIRRORED = ["event_id", "role", "model", "output_tokens"]

#: Streams over `events`, run to the end of what is there. Their SQL has the lens put before it.
STREAM_QUERIES = {
    "stream_transcripts": (_transcripts, ", w AS (SELECT session_id // 50 AS f, row_number() OVER (PARTITION BY session_id // 50 ORDER BY session_id, ordinal) - 1 AS o, role, content FROM turns) SELECT f::VARCHAR AS file, o AS ordinal, role, content, CASE WHEN role = 'assistant' THEN 'm' || o % 3 ELSE '' END AS model, role = 'system' AS is_system, f || '-' || o AS uuid, length(content) AS output_tokens FROM w"),
    "stream_mirror": (_mirror, " SELECT session_id, count(*) AS messages, sum(output_tokens)::BIGINT AS output_tokens, sha256(session_id || ':' || count(*) || ':' || sum(('0x' || substr(sha256(event_id || '|' || role || '|' || model || '|' || output_tokens), 1, 12))::BIGINT)) AS fingerprint FROM messages WHERE NOT is_automated AND user_id % 11 <> 3 GROUP BY 1"),
    "stream_recomputes": (_stream(jobs.recomputes, "append"), None),
    "stream_live_counts": (_stream(jobs.live_counts, "complete"), " SELECT project, count(*) AS messages, sum(output_tokens)::BIGINT AS output_tokens FROM messages GROUP BY 1"),
    "stream_versions": (_stream(lambda m: jobs.versions(m).withColumn("version", F.unix_micros("version")), "complete"), " SELECT session_id, count(*) AS messages, max(epoch_us(ts)) AS version FROM messages GROUP BY 1"),
    "stream_status": (_stream(lambda m: jobs.status(m, "2024-01-28 23:00:00"), "complete"), " SELECT session_id, CASE WHEN a < 600000000 THEN 'active' WHEN a < 3600000000 THEN 'stale' ELSE 'unclean' END AS status FROM (SELECT session_id, epoch_us(TIMESTAMP '2024-01-28 23:00:00') - max(epoch_us(ts)) AS a FROM messages GROUP BY 1)"),
    "stream_usage_windows": (_stream(jobs.usage_windows, "append"), ", a AS (SELECT date_trunc('hour', ts) AS h, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS requests FROM messages WHERE role = 'assistant' GROUP BY 1) SELECT strftime(h, '%Y-%m-%d %H') AS hour, output_tokens, requests FROM a WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM messages WHERE role = 'assistant') - INTERVAL 10 MINUTE"),
    "stream_activity_sessions": (_stream(jobs.activity_sessions, "append"), ", a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 300 SECOND THEN 0 ELSE 1 END AS new FROM messages), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT user_id, min(epoch_us(ts)) AS start, count(*) AS messages FROM b GROUP BY user_id, g HAVING max(ts) + INTERVAL 300 SECOND <= (SELECT max(ts) FROM messages) - INTERVAL 10 MINUTE"),
}
