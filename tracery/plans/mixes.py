"""Queries of mixes and trends, sides of a comparison, system rows and the mirror, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import folder_for
from ..operators import analytics, filters, maintain, usage
from ..sources.tables import Tables
from .reports import _STEPS, _SURVIVORS, _HALF

#: What some user turns begin with.
BEGINS = ["", "<system-reminder>a</system-reminder>\n <command-name>x", " \n<goal_context>y", "<system-reminder>only</system-reminder> ", "Stop hook feedback: z", "see <command-name>", "<system-reminder>open", "[Request interrupted by user]"]
SYSTEM = [False, True, True, False, True, False, False, True]


def _system(t: Tables) -> DataFrame:
    at = (F.col("session_id") + F.col("ordinal") * 3) % len(BEGINS)
    begun = F.element_at(F.array(*map(F.lit, BEGINS)), (at + 1).cast("int"))
    text = F.when(at == 3, begun).otherwise(F.concat(begun, "content"))  # nothing but a reminder
    return t.turns.select("session_id", "ordinal", filters.system_row(text, F.col("role")).alias("is_system_row"))


def _calls(t: Tables) -> DataFrame:
    s = F.col("session_id")
    return t.calls.withColumns({"agent": F.concat(F.lit("a"), (s % 3).cast("string")), "project": F.concat(F.lit("p"), (s % 5).cast("string"))})


def _mirror(t: Tables) -> DataFrame:
    """The model written as a mirror, and what is read back of it."""
    folder = folder_for(t.messages.sparkSession)
    maintain.write_mirror(t, folder)
    read = lambda name: t.messages.sparkSession.read.parquet(f"{folder}/{name}")
    own = read("sessions").select("session_id", F.col("project").cast("string").alias("project"), "message_count")
    return own.join(read("messages").groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("output_tokens").alias("output_tokens")), "session_id")


_SIDE = lambda name, test: f"count(*) FILTER ({test}) AS {name}_rows, count(DISTINCT session_id) FILTER ({test}) AS {name}_sessions, coalesce(sum(output_tokens) FILTER ({test}), 0)::BIGINT AS {name}_output, coalesce(sum(cost) FILTER ({test}), 0)::BIGINT AS {name}_cost"
_PCT = lambda p, x: f"round(list_sort(list({x}))[least(floor(count(*) * {p}::DOUBLE), count(*) - 1)::BIGINT + 1], 3)"
_CX = ", cx AS (SELECT *, 'a' || (session_id % 3) AS agent, 'p' || (session_id % 5) AS project FROM calls)"

QUERIES = {
    "filter_system_rows": (_system, f" SELECT session_id, ordinal, role = 'user' AND (((session_id + ordinal * 3) % 8 = 3) OR {[str(x).lower() for x in SYSTEM]}[(session_id + ordinal * 3) % 8 + 1] = 'true') AS is_system_row FROM turns"),
    "usage_sides": (lambda t: usage.compare_sides(usage.survivors(t), {"model": ["m0", "m1"], "agent": ["a0", "a1"]}, {"model": ["m1", "m2"], "project": ["p1", "p2"], "machine": ["h0", "h2", "h3"]}), f"{_SURVIVORS}, sd AS (SELECT {_SIDE('left', "model IN ('m0', 'm1') AND agent IN ('a0', 'a1')")}, {_SIDE('right', "model IN ('m1', 'm2') AND project IN ('p1', 'p2') AND machine IN ('h0', 'h2', 'h3')")} FROM w) SELECT *, right_sessions - left_sessions AS delta_sessions, right_output - left_output AS delta_output, right_cost - left_cost AS delta_cost, round(left_cost / nullif(left_sessions, 0), 6) AS left_per_session, round(right_cost / nullif(right_sessions, 0), 6) AS right_per_session FROM sd"),
    "analytics_tool_mix": (lambda t: analytics.tool_mix(_calls(t)), f"{_CX} SELECT agent, category, count(*) AS calls, count(DISTINCT session_id) AS sessions, {_HALF('(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY agent))')} AS pct FROM cx GROUP BY 1, 2"),
    "analytics_tool_trend": (lambda t: analytics.trend(t.calls, "category"), " SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, category, count(*) AS calls FROM calls GROUP BY 1, 2"),
    "analytics_skill_trend": (lambda t: analytics.trend(t.calls, "skill"), " SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, skill, count(*) AS calls FROM calls WHERE skill <> '' GROUP BY 1, 2"),
    "analytics_skill_mix": (lambda t: analytics.skill_mix(_calls(t)), f"{_CX}, sm AS (SELECT skill, unnest(['agent', 'project']) AS kind, unnest([agent, project]) AS label FROM cx WHERE skill <> '') SELECT skill, kind, label, count(*) AS calls, {_HALF('(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY skill, kind))')} AS pct FROM sm GROUP BY 1, 2, 3"),
    "analytics_velocity_by": (analytics.velocity_by, f"""{_STEPS}, ls AS (SELECT session_id, unnest(['all', 'agent', 'complexity']) AS kind, unnest(['', agent, CASE WHEN message_count <= 15 THEN '1-15' WHEN message_count <= 60 THEN '16-60' ELSE '61+' END]) AS label FROM sessions),
        x AS (SELECT ls.kind, ls.label, s.* FROM steps s JOIN ls USING (session_id)), c AS (SELECT kind, label, {_PCT(0.5, 'gap')} AS cycle_p50, {_PCT(0.9, 'gap')} AS cycle_p90 FROM x WHERE role = 'assistant' AND role_before = 'user' AND gap > 0 AND gap <= 1800 GROUP BY 1, 2),
        u AS (SELECT session_id, min(ordinal) AS o, arg_min(ts, ordinal) AS ts FROM messages WHERE role = 'user' GROUP BY 1), r AS (SELECT u.session_id, greatest((epoch_us(arg_min(m.ts, m.ordinal)) - epoch_us(any_value(u.ts))) / 1e6, 0) AS gap FROM u JOIN messages m ON m.session_id = u.session_id AND m.role = 'assistant' AND m.ordinal > u.o GROUP BY u.session_id),
        rp AS (SELECT kind, label, {_PCT(0.5, 'gap')} AS response_p50, {_PCT(0.9, 'gap')} AS response_p90 FROM r JOIN ls USING (session_id) GROUP BY 1, 2), n AS (SELECT kind, label, sum(least(gap, 300.0)) AS active, count(*) AS n, sum(content_length) AS chars, count(*) FILTER (has_tool_use) AS tools FROM x GROUP BY 1, 2)
        SELECT kind, label, round(n / (active / 60), 4) AS messages_per_minute, round(chars / (active / 60), 4) AS chars_per_minute, round(tools / (active / 60), 4) AS tool_turns_per_minute, cycle_p50, cycle_p90, response_p50, response_p90 FROM n LEFT JOIN c USING (kind, label) LEFT JOIN rp USING (kind, label)"""),
    "export_mirror": (_mirror, " SELECT session_id, project, message_count, count(*) AS messages, sum(output_tokens)::BIGINT AS output_tokens FROM sessions s JOIN messages m USING (session_id) GROUP BY session_id, s.project, message_count".replace("SELECT session_id, project,", "SELECT session_id, s.project AS project,").replace("sum(output_tokens)", "sum(m.output_tokens)")),
}
