"""Queries of where a session's time goes and of what models' names mean, with SQL oracles that are written from the rules.

Sessions are those of `events`; a message with a tool has up to three calls, some of the session that follows (nested where that has calls too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rates, timing
from ..sources.tables import Tables

NOW = "2024-03-01 00:00:00"
KINDS = ["Bash", "Edit", "Read", "Grep", "Other", "Skill", "Fetch"]


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _n() -> Column:
    return F.col("event_id") + F.col("call_index")


def _sessions(t: Tables) -> DataFrame:
    n = F.col("message_count")
    return t.sessions.select("session_id", F.when(n % 11 != 3, F.col("started_at")).alias("started_at"), F.when(n % 5 != 0, F.col("ended_at")).alias("ended_at"))


def _calls(t: Tables) -> DataFrame:
    e = F.col("event_id").cast("string")
    inputs = [
        F.concat(F.lit('{"file_path": "src/f'), e, F.lit('.py", "pattern": ""}')), F.concat(F.lit('{"command": "make '), e, F.lit('\\nall", "cmd": 1, "pattern": "p"}')),
        F.concat(F.lit('{"path": 5, "query": "q'), e, F.lit('", "pattern": null, "cmd": "ls"}')), F.lit("no json"), F.lit("[1]"),
        F.concat(F.lit('{"skill": "s'), e, F.lit('", "name": "x", "path": "'), F.lit("pé" * 60), F.lit('"}')), F.lit(None).cast("string"),
    ]
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (_n() % 7 + 1).cast("int"))
    below = t.sessions.where("relationship = 'subagent'").select(F.col("parent_id").alias("session_id"), F.col("session_id").alias("next"))
    rows = t.messages.where("has_tool_use").select("session_id", "ordinal", "event_id", "ts", F.explode(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("event_id") % 4)).alias("call_index"))
    rows = rows.join(below, "session_id", "left").withColumn("category", kind)
    return rows.select("session_id", "ordinal", "call_index", "event_id", "ts", "category", F.when(_n() % 2 == 0, "Bash").otherwise(F.concat(F.lower("category"), F.lit("_tool"))).alias("tool_name"), F.element_at(F.array(*inputs), (F.col("event_id") % 7 + 1).cast("int")).alias("input"), F.when(_n() % 3 == 1, F.col("next")).alias("child"))


def _events(calls: DataFrame) -> DataFrame:
    at = lambda seconds: F.timestamp_micros(F.unix_micros("ts") + seconds * 1_000_000)
    row = lambda i, status, ts: F.struct(F.lit(i).alias("event_index"), F.lit(status).alias("status"), ts.alias("ts"))
    rows = F.array(row(0, "started", F.when(_n() % 9 != 0, at(F.lit(2)))), row(1, "started", at(F.lit(4))), row(2, "completed", at(_n() % 90 - 5)), row(3, "errored", F.when(_n() % 5 == 0, at(_n() % 90 + 1))))
    return calls.where(_n() % 4 != 3).select("session_id", "ordinal", "call_index", F.when(_n() % 17 == 0, "hook").otherwise("tool_execution").alias("source"), F.inline(rows))


def _own(t: Tables) -> DataFrame:
    calls = _calls(t)
    return timing.own_times(calls.drop("ts", "event_id"), _events(calls), _sessions(t), _now())


def turns(t: Tables) -> DataFrame:
    return timing.turn_times(t.messages, _sessions(t), _own(t))


def calls(t: Tables) -> DataFrame:
    own = _own(t)
    return timing.call_times(own, timing.turn_times(t.messages, _sessions(t), own))


def categories(t: Tables) -> DataFrame:
    return timing.category_times(turns(t))


def sessions(t: Tables) -> DataFrame:
    own = _own(t)
    found = timing.turn_times(t.messages, _sessions(t), own)
    return timing.session_times(_sessions(t), found, timing.call_times(own, found), _now())


_TURNS = """, ts0 AS (SELECT session_id, CASE WHEN message_count % 11 <> 3 THEN started_at END AS started_at, CASE WHEN message_count % 5 <> 0 THEN ended_at END AS ended_at FROM sessions),
nx AS (SELECT parent_id AS session_id, session_id AS next FROM sessions WHERE relationship = 'subagent'),
tc0 AS (SELECT m.session_id, ordinal, event_id, ts, i AS call_index, event_id + i AS n, ['Bash', 'Edit', 'Read', 'Grep', 'Other', 'Skill', 'Fetch'][(event_id + i) % 7 + 1] AS category, next FROM messages m CROSS JOIN (VALUES (0), (1), (2)) v(i) LEFT JOIN nx ON nx.session_id = m.session_id WHERE has_tool_use AND i < event_id % 4),
tc AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'Bash' ELSE lower(category) || '_tool' END AS tool_name, CASE WHEN n % 3 = 1 THEN next END AS child,
  [('{"file_path": "src/f' || event_id || '.py", "pattern": ""}'), ('{"command": "make ' || event_id || '\\nall", "cmd": 1, "pattern": "p"}'), ('{"path": 5, "query": "q' || event_id || '", "pattern": null, "cmd": "ls"}'), 'no json', '[1]', ('{"skill": "s' || event_id || '", "name": "x", "path": "' || repeat('pé', 60) || '"}'), NULL][event_id % 7 + 1] AS input FROM tc0),
te AS (SELECT session_id, ordinal, call_index, k, CASE WHEN k < 2 THEN 'started' WHEN k = 2 THEN 'completed' ELSE 'errored' END AS status,
  CASE k WHEN 0 THEN CASE WHEN n % 9 <> 0 THEN ts + INTERVAL 2 SECOND END WHEN 1 THEN ts + INTERVAL 4 SECOND WHEN 2 THEN ts + to_seconds(n % 90 - 5) ELSE CASE WHEN n % 5 = 0 THEN ts + to_seconds(n % 90 + 1) END END AS moment
  FROM tc CROSS JOIN (VALUES (0), (1), (2), (3)) v(k) WHERE n % 4 <> 3 AND n % 17 <> 0),
tr AS (SELECT session_id, ordinal, call_index, first(moment ORDER BY k) FILTER (status = 'started') AS began, last(moment ORDER BY k) FILTER (status <> 'started') AS finished FROM te WHERE moment IS NOT NULL GROUP BY ALL),
ow AS (SELECT tc.*, CASE WHEN ch.started_at IS NOT NULL THEN trunc((epoch_us(coalesce(ch.ended_at, TIMESTAMP '2024-03-01')) - epoch_us(ch.started_at)) / 1000)::BIGINT END AS sub, trunc((epoch_us(finished) - epoch_us(began)) / 1000)::BIGINT AS span, finished
  FROM tc LEFT JOIN tr USING (session_id, ordinal, call_index) LEFT JOIN ts0 ch ON ch.session_id = tc.child),
oc AS (SELECT *, coalesce(sub, CASE WHEN span >= 0 THEN span END) AS took, CASE WHEN sub IS NULL AND span >= 0 THEN finished END AS completed FROM ow),
pt AS (SELECT session_id, ordinal, count(*) AS calls, count(child) AS children, count(completed) AS ends, max(completed) AS boundary, count(*) FILTER (NOT (child IS NOT NULL AND took IS NOT NULL)) AS others,
  greatest(coalesce(max(took) FILTER (child IS NOT NULL), 0), 0) AS longest, coalesce(sum(took) FILTER (child IS NOT NULL AND took > 0), 0)::BIGINT AS task_ms, count(*) FILTER (child IS NOT NULL AND took > 0) AS tasks FROM oc GROUP BY ALL),
mj AS (SELECT session_id, ordinal, category FROM oc JOIN pt USING (session_id, ordinal) WHERE NOT (child IS NOT NULL AND took IS NOT NULL) GROUP BY session_id, ordinal, category, pt.others HAVING count(*) * 2 > pt.others),
ld AS (SELECT session_id, ordinal, ts, has_tool_use, lead(ts) OVER (PARTITION BY session_id ORDER BY ordinal) AS after FROM messages),
tt AS (SELECT ld.session_id, ld.ordinal, ld.ts, coalesce(calls, 0) AS calls, coalesce(children, 0) AS children, coalesce(longest, 0) AS longest, coalesce(task_ms, 0) AS task_ms, coalesce(tasks, 0) AS tasks, mj.category AS major,
  trunc((epoch_us(coalesce(after, ended_at)) - epoch_us(ts)) / 1000)::BIGINT AS lasted, CASE WHEN ends = calls THEN trunc((epoch_us(boundary) - epoch_us(ts)) / 1000)::BIGINT END AS cut
  FROM ld JOIN ts0 USING (session_id) LEFT JOIN pt USING (session_id, ordinal) LEFT JOIN mj USING (session_id, ordinal) WHERE has_tool_use),
tm AS (SELECT *, CASE WHEN cut >= 0 THEN cut WHEN lasted >= 0 THEN lasted END AS ms FROM tt),
tq AS (SELECT session_id, ordinal, ts, ms, calls, children, CASE WHEN ms IS NULL THEN 'Mixed' WHEN longest > 0 AND longest >= greatest(ms - longest, 0) THEN 'Task' ELSE coalesce(major, 'Mixed') END AS category,
  CASE WHEN ms IS NULL THEN 0 ELSE greatest(ms - longest, 0) END AS rest, CASE WHEN ms IS NULL THEN 0 ELSE task_ms END AS task_ms, CASE WHEN ms IS NULL THEN 0 ELSE tasks END AS tasks FROM tm)"""
_TEXT = lambda k: f"CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' THEN nullif(json_extract_string(j, '$.{k}'), '') END"
_FIRST = lambda *names: f"coalesce({', '.join(map(_TEXT, names))}, '')"
_CALLS = f"""{_TURNS}, jc AS (SELECT oc.*, CASE WHEN json_valid(input) THEN input::JSON END AS j, CASE WHEN category IN ('', 'Other', 'Tool') THEN tool_name ELSE category END AS kind FROM oc),
pv AS (SELECT *, CASE kind WHEN 'Read' THEN {_FIRST('file_path', 'path')} WHEN 'Edit' THEN {_FIRST('file_path', 'path', 'filePath', 'file')} WHEN 'Write' THEN {_FIRST('file_path', 'path', 'file')} WHEN 'Grep' THEN {_FIRST('pattern', 'query')} WHEN 'Glob' THEN {_FIRST('pattern', 'path')}
  WHEN 'Bash' THEN split_part({_FIRST('command', 'cmd')}, chr(10), 1) WHEN 'Skill' THEN {_FIRST('skill', 'name')} WHEN 'skill' THEN {_FIRST('skill', 'name')} ELSE {_FIRST('file_path', 'path', 'pattern', 'command', 'cmd')} END AS p FROM jc),
cq AS (SELECT pv.session_id, pv.ordinal, call_index, pv.category, tool_name, child, coalesce(took, CASE WHEN tq.calls = 1 AND child IS NULL THEN tq.ms END) AS ms, tq.calls > 1 AS parallel, CASE WHEN length(p) > 100 THEN left(p, 100) || '…' ELSE p END AS preview FROM pv JOIN tq USING (session_id, ordinal))"""

#: Names and keys of `models_matched`, each name met by a rule of its own.
NAMES = [
    "m0", "m1.5", "M2", "M1.5", "acme/m3", "m3", "other/m4", "m4", "m5 (Medium)", "m5[1m]", "m5-20240101", "m5-20240101[1m]", "m5.1-codex", "both", "three/both", "Ambig", "x/y/Deep.1", "(x)", "", "none", "m6 (High) ", "M-7", "m7-2024010", "one/m8-20231231", "m9 (a)(b)", "acme /m3",
]
KEYS = ["m0", "m1-5", "m2", "M2", "acme/m3", "best/m3", "m3-x", "best/m4", "m5", "one/both", "two/both", "am-big", "a.mbig", "x-y/deep1", "m6", "m7", "other/m8", "one/m8", "m8", "m9(a)"]


def matched(t: Tables) -> DataFrame:
    """The models of all messages, each under one of NAMES (by its event's number), with what they mean and their rows."""
    names = t.messages.where("model <> ''").select(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES) + 1).cast("int")).alias("model"))
    keys = names.sparkSession.createDataFrame([(k,) for k in KEYS], "key string")
    return names.groupBy("model").agg(F.count(F.lit(1)).alias("rows")).join(rates.resolve(names, keys), "model")


_MEANT = [
    ("m0", "m0", 0), ("m1.5", "m1-5", 1), ("M2", "M2", 0), ("M1.5", "m1-5", 3), ("acme/m3", "acme/m3", 0), ("other/m4", None, None), ("m4", "best/m4", 4), ("m5 (Medium)", "m5", 5), ("m5[1m]", "m5", 5), ("m5-20240101", "m5", 6),
    ("m5-20240101[1m]", "m5", 6), ("m5.1-codex", None, None), ("both", None, None), ("three/both", None, None), ("Ambig", None, None), ("x/y/Deep.1", "x-y/deep1", 4), ("(x)", None, None), ("", None, None), ("none", None, None), ("m3", None, None),
    ("m6 (High) ", "m6", 5), ("M-7", "m7", 4), ("m7-2024010", None, None), ("one/m8-20231231", "one/m8", 6), ("m9 (a)(b)", "m9(a)", 5), ("acme /m3", "acme/m3", 4),
]
_text = lambda x: "NULL" if x is None else f"'{x}'"

QUERIES = {
    "timing_turns": (turns, f"{_TURNS} SELECT * FROM tq"),
    "timing_calls": (calls, f"{_CALLS} SELECT * FROM cq"),
    "timing_categories": (categories, f"{_TURNS} SELECT session_id, category, sum(ms)::BIGINT AS ms, sum(calls)::BIGINT AS calls FROM (SELECT session_id, category, rest AS ms, calls FROM tq UNION ALL SELECT session_id, 'Task', task_ms, tasks FROM tq) WHERE ms > 0 GROUP BY 1, 2"),
    "timing_sessions": (sessions, f"""{_CALLS}, sl AS (SELECT * FROM cq WHERE ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ms DESC, ordinal, call_index) = 1), sg AS (SELECT session_id, sum(ms)::BIGINT AS tool_ms, count(*) AS turns, sum(calls)::BIGINT AS calls, sum(children)::BIGINT AS children FROM tq GROUP BY 1)
        SELECT session_id, coalesce(trunc((epoch_us(coalesce(ended_at, TIMESTAMP '2024-03-01')) - epoch_us(started_at)) / 1000)::BIGINT, 0) AS total_ms, ended_at IS NULL AS running, coalesce(tool_ms, 0) AS tool_ms, coalesce(turns, 0) AS turns, coalesce(sg.calls, 0) AS calls, coalesce(children, 0) AS children,
        sl.ordinal AS slowest_ordinal, sl.call_index AS slowest_call, sl.ms AS slowest_ms, sl.preview AS slowest_preview FROM ts0 LEFT JOIN sg USING (session_id) LEFT JOIN sl USING (session_id)"""),
    "models_matched": (matched, f""", mn AS (SELECT [{', '.join(map(_text, NAMES))}][event_id % {len(NAMES)} + 1] AS model FROM messages WHERE model <> '') SELECT mn.model, v.key, v.stage, count(*) AS rows FROM mn JOIN (VALUES {', '.join(f"({_text(m)}, {_text(k)}, {'NULL' if s is None else s})" for m, k, s in _MEANT)}) v(model, key, stage) USING (model) GROUP BY ALL"""),
}
