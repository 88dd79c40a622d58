"""Queries of the usage, filter and dashboard families, each with its equivalent in DuckDB's SQL (after LENS_SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, filters, usage
from ..sources.tables import Tables

# The pieces of SQL that several oracles begin with, as CTEs after the lens.
_SURVIVORS = """, u0 AS (SELECT *, least(greatest(input_tokens, 0), 2000000) AS i, least(greatest(output_tokens, 0), 2000000) AS o FROM messages WHERE role = 'assistant' AND model <> ''),
s0 AS (SELECT * FROM u0 WHERE message_id <> '' AND request_id <> ''),
f0 AS (SELECT DISTINCT ON (message_id, request_id) message_id, request_id, session_id, project, agent, machine, branch, is_automated, user_id FROM s0 ORDER BY message_id, request_id, ts, session_id, ordinal),
b0 AS (SELECT DISTINCT ON (message_id, request_id) * FROM s0 ORDER BY message_id, request_id, output_tokens DESC, ts DESC, event_id DESC),
k0 AS (SELECT f0.session_id, f0.project, f0.agent, f0.machine, f0.branch, b0.ordinal, b0.ts, b0.model, b0.input_tokens, b0.output_tokens, b0.cache_creation, b0.cache_read, b0.message_id, b0.request_id, b0.source_uuid FROM b0 JOIN f0 USING (message_id, request_id)
  UNION ALL SELECT session_id, project, agent, machine, branch, ordinal, ts, model, input_tokens, output_tokens, cache_creation, cache_read, message_id, request_id, source_uuid FROM u0 WHERE message_id = '' OR request_id = ''),
d0 AS (SELECT * FROM k0 QUALIFY row_number() OVER (PARTITION BY CASE WHEN message_id <> '' AND request_id <> '' THEN 'r|' || message_id || '|' || request_id ELSE 'u|' || agent || '|' || source_uuid END ORDER BY ts, session_id, ordinal) = 1),
card(model, ri, ro, rc, rr, ti, t_o, tc, tr) AS (VALUES ('m0', 3000000, 15000000, 3750000, 300000, 6000000, 22500000, 7500000, 600000), ('m1', 800000, 4000000, 1000000, 80000, 800000, 4000000, 1000000, 80000)),
rated AS (SELECT d0.*, ri IS NOT NULL AS priced, CASE WHEN big THEN ti ELSE ri END AS ri, CASE WHEN big THEN t_o ELSE ro END AS ro, CASE WHEN big THEN tc ELSE rc END AS rc, CASE WHEN big THEN tr ELSE rr END AS rr
  FROM (SELECT *, model = 'm0' AND input_tokens + cache_read + cache_creation > 900 AS big FROM d0) d0 LEFT JOIN card USING (model)),
v AS (SELECT *, strftime(ts, '%Y-%m-%d') AS date,
  coalesce(floor((input_tokens::HUGEINT * ri + output_tokens::HUGEINT * ro + cache_creation::HUGEINT * rc + cache_read::HUGEINT * rr + 500000)::DOUBLE / 1000000)::BIGINT, 0) AS cost,
  coalesce((cache_read * (ri - rr) + cache_creation * (ri - rc))::BIGINT, 0) AS saved6 FROM rated),
w AS (SELECT *, (sign(saved6) * floor((abs(saved6) + 500000)::DOUBLE / 1000000))::BIGINT AS savings FROM v)"""
_SUMS = "sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation)::BIGINT AS cache_creation, sum(cache_read)::BIGINT AS cache_read, sum(cost)::BIGINT AS cost, sum(savings)::BIGINT AS savings"
_OWN = """, own AS (SELECT * FROM sessions WHERE message_count > 0 AND relationship IN ('', 'continuation') AND started_at::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-24' AND NOT is_automated AND user_message_count > 1)"""
_VISIBLE = "message_count > 0 AND relationship IN ('', 'continuation')"
_STEPS = """, steps AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ordinal))) / 1e6 AS gap, lag(role) OVER (PARTITION BY session_id ORDER BY ordinal) AS role_before FROM messages)"""
_HALF = lambda x, p=1: f"(sign({x}) * floor(abs({x}) * {10**p} + 0.5) / {10**p})"

_HEAT = lambda table, ts, value: f", d AS (SELECT s.d::DATE AS d, {value} AS v FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS d) s LEFT JOIN {table} m ON m.{ts}::DATE = s.d::DATE GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM d WHERE v > 0), l AS (SELECT max(v) FILTER (k = n // 4) AS l2, max(v) FILTER (k = n // 2) AS l3, max(v) FILTER (k = n * 3 // 4) AS l4 FROM r) SELECT strftime(d, '%Y-%m-%d') AS date, v AS value, CASE WHEN v <= 0 THEN 0 WHEN v <= l2 THEN 1 WHEN v <= l3 THEN 2 WHEN v <= l4 THEN 3 ELSE 4 END::INTEGER AS level FROM d, l"


def _bucket(x: str, edges: list, top: str, closed: bool = False) -> str:
    return "CASE " + " ".join(f"WHEN {x} {'<=' if closed else '<'} {e} THEN '{label}'" for e, label in edges) + f" ELSE '{top}' END"


def _statuses(t: Tables):
    return filters.termination(t.sessions, "2024-01-28 23:00:00", F.col("user_id") % 2 == 0).select("session_id", "status")


def _call_times(t: Tables):
    """Text sessions, a day for each number and a minute for each turn, with the calls of the order with their number."""
    said = t.turns.select("session_id", "ordinal", F.timestamp_seconds(F.col("session_id") * 86400 + F.col("ordinal") * 60).alias("ts"))
    return analytics.call_times(t.calls.join(said.select("session_id").distinct(), "session_id", "left_semi"), said)


def _anchors(t: Tables):
    return filters.around(t.turns, t.turns.where("ordinal = 2").select("session_id", F.col("ordinal").alias("anchor")))


QUERIES = {
    "usage_daily": (usage.daily, f"{_SURVIVORS} SELECT date, model, {_SUMS}, count(DISTINCT session_id) AS sessions FROM w GROUP BY 1, 2"),
    "usage_breakdowns": (usage.breakdowns, f"{_SURVIVORS} SELECT date, kind, label, sum(output_tokens)::BIGINT AS output_tokens, sum(cost)::BIGINT AS cost FROM (SELECT date, output_tokens, cost, unnest(['project', 'agent', 'machine', 'model']) AS kind, unnest([project, agent, machine, model]) AS label FROM w) GROUP BY 1, 2, 3"),
    "usage_summary": (usage.summary, f"{_SURVIVORS} SELECT {_SUMS}, round(sum(cache_read) / (sum(cache_read) + sum(input_tokens)), 6) AS hit_rate, count(DISTINCT session_id) AS sessions FROM w"),
    "usage_pairwise": (usage.pairwise, f"{_SURVIVORS}, p AS (SELECT (sum(cost) FILTER (model = 'm0'))::BIGINT AS l, (sum(cost) FILTER (model = 'm1'))::BIGINT AS r, count(DISTINCT session_id) FILTER (model = 'm0') AS ln, count(DISTINCT session_id) FILTER (model = 'm1') AS rn FROM w) SELECT l AS left_cost, r AS right_cost, ln AS left_sessions, rn AS right_sessions, r - l AS delta_cost, round(l / ln, 6) AS left_per_session, round(r / rn, 6) AS right_per_session FROM p"),
    "usage_top_sessions": (usage.top_sessions, f"{_SURVIVORS} SELECT session_id, project, agent, sum(cost)::BIGINT AS cost, sum(output_tokens)::BIGINT AS output_tokens FROM w GROUP BY 1, 2, 3 ORDER BY cost DESC, session_id LIMIT 20"),
    "usage_session_counts": (usage.session_counts, f"{_SURVIVORS} SELECT kind, label, count(DISTINCT session_id) AS sessions FROM (SELECT session_id, unnest(['all', 'project', 'agent']) AS kind, unnest(['', project, agent]) AS label FROM w) GROUP BY 1, 2"),
    "usage_matching_sessions": (usage.matching_sessions, " SELECT count(DISTINCT session_id) AS sessions FROM messages WHERE role = 'assistant'"),
    "usage_per_session": (usage.per_session, f"{_SURVIVORS} SELECT session_id, bool_and(priced) AS has_cost, string_agg(DISTINCT model, ',' ORDER BY model) AS models, coalesce(string_agg(DISTINCT model, ',' ORDER BY model) FILTER (NOT priced), '') AS unpriced, sum(output_tokens)::BIGINT AS output_tokens, CASE WHEN bool_and(priced) THEN sum(cost)::BIGINT END AS cost FROM w GROUP BY 1"),
    "usage_session_models": (usage.session_models, f"{_SURVIVORS} SELECT session_id, model, {_SUMS} FROM w GROUP BY 1, 2"),
    "usage_provenance": (usage.provenance, f"{_SURVIVORS} SELECT model, count(*) AS rows, bool_or(priced) AS priced, CASE WHEN bool_and(priced) THEN 'computed' ELSE 'unpriced' END AS source FROM w GROUP BY 1"),
    "usage_allocated": (lambda t: usage.allocated(t, t.sessions.select("session_id", (F.col("message_count") * 1001).alias("total"))), f"{_SURVIVORS}, c AS (SELECT session_id, model, sum(cost)::BIGINT AS cost FROM w GROUP BY 1, 2), g AS (SELECT session_id, model, message_count * 1001 AS total, CASE WHEN sum(greatest(cost, 0)) OVER p = 0 THEN 1 ELSE greatest(cost, 0) END AS k FROM c JOIN sessions USING (session_id) WINDOW p AS (PARTITION BY session_id)), h AS (SELECT *, ((total::HUGEINT * k) // (sum(k) OVER (PARTITION BY session_id))::HUGEINT)::BIGINT AS part, row_number() OVER (PARTITION BY session_id ORDER BY k > 0 DESC, model DESC) AS turn FROM g) SELECT session_id, model, total, (part + CASE WHEN turn = 1 THEN total - sum(part) OVER (PARTITION BY session_id) ELSE 0 END)::BIGINT AS share FROM h"),
    "usage_snapshots": (lambda t: usage.snapshots(usage.usage_rows(t)).select("session_id", "ordinal", "model", "output_tokens"), f"{_SURVIVORS} SELECT session_id, ordinal, model, output_tokens FROM k0"),
    "usage_dedup": (lambda t: usage.dedup(usage.usage_rows(t)).select("session_id", "ordinal"), ", u0 AS (SELECT * FROM messages WHERE role = 'assistant' AND model <> '') SELECT session_id, ordinal FROM u0 QUALIFY row_number() OVER (PARTITION BY CASE WHEN message_id <> '' AND request_id <> '' THEN 'r|' || message_id || '|' || request_id ELSE 'u|' || agent || '|' || source_uuid END ORDER BY ts, session_id, ordinal) = 1"),
    "filter_analytics": (lambda t: filters.analytics_filter(t).select("session_id"), f"{_OWN} SELECT session_id FROM own"),
    "filter_models": (lambda t: filters.analytics_filter(t, models=["m2"], projects=["p1", "p2"], scope="all").select("session_id"), f" SELECT session_id FROM sessions WHERE {_VISIBLE} AND started_at::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-24' AND (user_message_count > 1 OR is_automated) AND project IN ('p1', 'p2') AND session_id IN (SELECT session_id FROM messages WHERE model = 'm2')"),
    "filter_local_dates": (lambda t: filters.in_dates(t.sessions, "started_at", "2024-01-08", "2024-01-15", "America/New_York").select("session_id"), " SELECT session_id FROM sessions WHERE (started_at::TIMESTAMP - INTERVAL 5 HOUR)::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-15'"),
    "filter_day_hour": (lambda t: filters.day_hour_filter(t, 2, 14).select("session_id"), " SELECT session_id FROM sessions WHERE session_id IN (SELECT session_id FROM messages WHERE isodow(ts) = 3 AND hour(ts) = 14)"),
    "filter_model_scope": (lambda t: filters.scope_stats(filters.model_scope(t.messages, ["m1"])), ", n AS (SELECT *, first_value(CASE WHEN role = 'assistant' THEN model END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nm FROM messages) SELECT session_id, count(*) AS messages, count(*) FILTER (role = 'user') AS \"user\", count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (has_tool_use) AS tool_use, count(*) FILTER (has_thinking) AS thinking, sum(output_tokens)::BIGINT AS output_tokens FROM n WHERE model = 'm1' OR (role = 'user' AND model = '' AND nm = 'm1') GROUP BY 1"),
    "filter_list": (lambda t: filters.list_filter(t, "2024-01-05", "2024-01-10", 3, 40, t.sessions.where("user_id % 3 = 0").select("session_id")).select("session_id"), " SELECT session_id FROM sessions WHERE relationship IN ('', 'continuation', 'subagent') AND started_at < TIMESTAMP '2024-01-11' AND ended_at >= TIMESTAMP '2024-01-05' AND message_count BETWEEN 3 AND 40 AND user_id % 3 = 0"),
    "filter_branch_pairs": (lambda t: filters.branch_pairs(t.sessions, [("p1", "b0"), ("p2", "b1")]).select("session_id"), " SELECT session_id FROM sessions WHERE (project = 'p1' AND branch = 'b0') OR (project = 'p2' AND branch = 'b1')"),
    "filter_termination": (_statuses, " SELECT session_id, CASE WHEN a < 600 THEN 'active' WHEN f AND a < 3600 THEN 'stale' WHEN f THEN 'unclean' ELSE 'clean' END AS status FROM (SELECT session_id, user_id % 2 = 0 AS f, (epoch_us(TIMESTAMP '2024-01-28 23:00:00') - epoch_us(ended_at)) / 1e6 AS a FROM sessions)"),
    "filter_automation": (lambda t: t.sessions.where(filters.automation("automated") & filters.not_one_shot("all")).select("session_id"), " SELECT session_id FROM sessions WHERE is_automated"),
    "filter_contains": (lambda t: t.turns.where(filters.contains_literal(F.col("content"), "THE o")).select("session_id", "ordinal"), " SELECT session_id, ordinal FROM turns WHERE contains(lower(content), 'the o')"),
    "messages_around": (_anchors, ", a AS (SELECT session_id, ordinal AS anchor FROM turns WHERE ordinal = 2), n AS (SELECT session_id, anchor, ordinal, role, row_number() OVER (PARTITION BY session_id, anchor, ordinal > anchor ORDER BY abs(ordinal - anchor)) AS turn FROM a JOIN turns USING (session_id) WHERE role IN ('user', 'assistant') AND ordinal <> anchor) SELECT session_id, anchor, ordinal, role FROM n WHERE turn <= 2 UNION ALL SELECT session_id, anchor, ordinal, role FROM a JOIN turns USING (session_id) WHERE ordinal = anchor"),
    "analytics_summary": (analytics.summary, f"{_OWN}, r AS (SELECT message_count, row_number() OVER (ORDER BY message_count) - 1 AS k, count(*) OVER () AS n FROM own), b AS (SELECT project, sum(message_count) AS m FROM own GROUP BY 1 ORDER BY m DESC, project LIMIT 3) SELECT count(*) AS sessions, sum(message_count)::BIGINT AS messages, sum(total_output_tokens)::BIGINT AS output_tokens, count(DISTINCT project) AS projects, count(DISTINCT started_at::DATE) AS days, {_HALF('avg(message_count)')} AS avg_messages, (SELECT ((max(message_count) FILTER (k = (n - 1) // 2) + max(message_count) FILTER (k = n // 2)) // 2)::BIGINT FROM r) AS median_messages, (SELECT max(message_count) FILTER (k = least(floor(n * 0.9), n - 1)) FROM r) AS p90_messages, {_HALF('((SELECT sum(m) FROM b) / sum(message_count))', 3)} AS concentration, (SELECT project FROM b ORDER BY m DESC, project LIMIT 1) AS most_active FROM own"),
    "analytics_by_agent": (analytics.by_agent, f"{_OWN} SELECT agent, count(*) AS sessions, sum(message_count)::BIGINT AS messages FROM own GROUP BY 1"),
    "analytics_activity": (analytics.activity, f"{_OWN} SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS bucket, count(DISTINCT session_id) AS sessions, count(*) AS messages, count(*) FILTER (role = 'user') AS \"user\", count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (has_thinking) AS thinking, count(*) FILTER (has_tool_use) AS tool_use FROM messages WHERE session_id IN (SELECT session_id FROM own) GROUP BY 1"),
    "analytics_heatmap": (analytics.heatmap, ", d AS (SELECT s.d::DATE AS d, count(m.ts) AS v FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS d) s LEFT JOIN messages m ON m.ts::DATE = s.d::DATE GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM d WHERE v > 0), l AS (SELECT max(v) FILTER (k = n // 4) AS l2, max(v) FILTER (k = n // 2) AS l3, max(v) FILTER (k = n * 3 // 4) AS l4 FROM r) SELECT strftime(d, '%Y-%m-%d') AS date, v AS value, CASE WHEN v <= 0 THEN 0 WHEN v <= l2 THEN 1 WHEN v <= l3 THEN 2 WHEN v <= l4 THEN 3 ELSE 4 END::INTEGER AS level FROM d, l"),
    "analytics_projects": (analytics.projects, f"{_OWN}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY message_count) - 1 AS k, count(*) OVER (PARTITION BY project) AS n FROM own) SELECT project, count(*) AS sessions, sum(message_count)::BIGINT AS messages, strftime(min(started_at), '%Y-%m-%d') AS \"first\", strftime(max(started_at), '%Y-%m-%d') AS \"last\", {_HALF('avg(message_count)')} AS mean, ((max(message_count) FILTER (k = (n - 1) // 2) + max(message_count) FILTER (k = n // 2)) // 2)::BIGINT AS median, count(DISTINCT started_at::DATE) AS days, {_HALF('(sum(message_count) / count(DISTINCT started_at::DATE))')} AS daily FROM r GROUP BY 1"),
    "analytics_hour_of_week": (analytics.hour_of_week, f"{_OWN} SELECT c.day::INTEGER AS day, c.hour::INTEGER AS hour, count(m.ts) AS messages FROM (SELECT x // 24 AS day, x % 24 AS hour FROM range(168) t(x)) c LEFT JOIN (SELECT ts FROM messages WHERE session_id IN (SELECT session_id FROM own)) m ON isodow(m.ts) - 1 = c.day AND hour(m.ts) = c.hour GROUP BY 1, 2"),
    "analytics_shape": (analytics.shape, f"{_OWN}, j AS (SELECT own.*, t.tools FROM own JOIN (SELECT session_id, count(*) FILTER (has_tool_use) AS tools FROM messages GROUP BY 1) t USING (session_id)), k AS (SELECT unnest(['length', 'duration', 'autonomy']) AS kind, unnest([{_bucket('message_count', analytics.LENGTHS, '121+', True)}, {_bucket('(epoch_us(ended_at) - epoch_us(started_at)) / 6e7', analytics.MINUTES, '2h+')}, {_bucket('tools / user_message_count', analytics.AUTONOMY, '10+')}]) AS label FROM j) SELECT kind, label, count(*) AS sessions FROM k GROUP BY 1, 2"),
    "analytics_tools": (analytics.tools, f" SELECT category, tool_name, count(*) AS calls, count(DISTINCT session_id) AS sessions, {_HALF('(100.0::DOUBLE * count(*) / sum(count(*)) OVER ())')} AS pct FROM calls GROUP BY 1, 2"),
    "analytics_skills": (analytics.skills, " SELECT skill, count(*) AS calls, count(DISTINCT session_id) AS sessions, strftime(max(ts), '%Y-%m-%d') AS last_used FROM calls WHERE skill <> '' GROUP BY 1"),
    "analytics_velocity": (analytics.velocity, f"{_STEPS}, x AS (SELECT *, unnest(['all', agent]) AS label FROM steps), c AS (SELECT label, gap, row_number() OVER (PARTITION BY label ORDER BY gap) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM x WHERE role = 'assistant' AND role_before = 'user' AND gap > 0 AND gap <= 1800), p AS (SELECT label, round(max(gap) FILTER (k = least(floor(n * 0.5), n - 1)), 3) AS p50, round(max(gap) FILTER (k = least(floor(n * 0.9), n - 1)), 3) AS p90, count(*) AS cycles FROM c GROUP BY 1), r AS (SELECT label, sum(least(gap, 300.0)) AS active, count(*) AS n, sum(content_length) AS chars FROM x GROUP BY 1) SELECT label, p50, p90, cycles, round(n / (active / 60), 4) AS messages_per_minute, round(chars / (active / 60), 4) AS chars_per_minute FROM r LEFT JOIN p USING (label)"),
    "analytics_top_sessions": (analytics.top_sessions, f"{_STEPS} SELECT session_id, s.project, round(coalesce(sum(least(gap, 300.0)), 0), 3) AS active_seconds, message_count FROM sessions s JOIN steps USING (session_id) WHERE {_VISIBLE} GROUP BY session_id, s.project, message_count ORDER BY active_seconds DESC, session_id LIMIT 10"),
    "analytics_archive_stats": (analytics.archive_stats, f" SELECT count(*) AS sessions, sum(message_count)::BIGINT AS messages, count(DISTINCT project) AS projects, count(DISTINCT machine) AS machines, strftime(min(started_at), '%Y-%m-%d') AS earliest FROM sessions WHERE {_VISIBLE}"),
    "analytics_dimensions": (analytics.dimensions, f" SELECT kind, label, count(*) AS sessions FROM (SELECT unnest(['project', 'agent', 'machine', 'branch']) AS kind, unnest([project, agent, machine, branch]) AS label FROM sessions WHERE {_VISIBLE}) GROUP BY 1, 2"),
    "analytics_inventory": (analytics.inventory, " SELECT project, count(*) AS sessions, count(DISTINCT machine) AS machines, count(DISTINCT agent) AS agents, count(DISTINCT cwd) AS cwds, strftime(min(started_at), '%Y-%m-%d') AS \"first\", strftime(max(ended_at), '%Y-%m-%d') AS \"last\" FROM sessions GROUP BY 1"),
    "analytics_models_used": (analytics.models_used, f"{_OWN} SELECT DISTINCT model FROM messages WHERE model <> '' AND session_id IN (SELECT session_id FROM own)"),
    "analytics_resume_models": (analytics.resume_models, " SELECT session_id, model, count(*) AS messages FROM messages WHERE role = 'assistant' GROUP BY 1, 2"),
    "stats_archetypes": (analytics.archetypes, f" SELECT {_bucket('user_message_count', [(5, 'quick'), (15, 'standard'), (50, 'deep')], 'marathon', True)} AS archetype, count(*) AS sessions, sum(message_count)::BIGINT AS messages FROM sessions WHERE {_VISIBLE} AND NOT is_automated GROUP BY 1"),
    "stats_distributions": (analytics.distributions, f", o AS (SELECT 'all' AS scope, user_message_count AS u FROM sessions WHERE {_VISIBLE} UNION ALL SELECT 'human', user_message_count FROM sessions WHERE {_VISIBLE} AND NOT is_automated) SELECT scope, {_bucket('u', [(2, '0-1'), (6, '2-5'), (16, '6-15'), (51, '16-50')], '51+')} AS label, count(*) AS sessions, round(any_value(m), 6) AS mean FROM o JOIN (SELECT scope, avg(u) AS m FROM o GROUP BY 1) USING (scope) GROUP BY 1, 2"),
    "stats_model_mix": (analytics.model_mix, " SELECT model, sum(output_tokens)::BIGINT AS output_tokens FROM messages WHERE model <> '' GROUP BY 1 HAVING sum(output_tokens) > 0"),
    "stats_portfolio": (analytics.portfolio, " SELECT agent, count(*) AS sessions, count(*) FILTER (NOT is_automated) AS human_sessions, sum(message_count)::BIGINT AS messages, sum(total_output_tokens)::BIGINT AS tokens, row_number() OVER (ORDER BY count(*) DESC, agent) = 1 AS is_primary FROM sessions GROUP BY 1"),
    "stats_cache_economics": (analytics.cache_economics, ", o AS (SELECT session_id, sum(cache_read) AS r, sum(input_tokens + cache_read + cache_creation) AS n FROM messages WHERE role = 'assistant' GROUP BY 1 HAVING n > 0) SELECT least(floor(r * 10 / n), 9)::INTEGER AS tenth, count(*) AS sessions, sum(r)::BIGINT AS reads, sum(n)::BIGINT AS total FROM o GROUP BY 1"),
    "stats_hourly": (analytics.hourly, " SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS messages, count(DISTINCT session_id) AS sessions FROM messages WHERE role = 'user' GROUP BY 1"),
    "stats_velocity": (analytics.velocity_block, f"""{_STEPS.replace("FROM messages)", f"FROM messages WHERE session_id IN (SELECT session_id FROM sessions WHERE {_VISIBLE}))")}, c AS (SELECT gap FROM steps WHERE role = 'assistant' AND role_before = 'user' AND gap > 0 AND gap <= 1800),
        u AS (SELECT session_id, min(ordinal) AS o, arg_min(ts, ordinal) AS ts FROM messages WHERE role = 'user' AND session_id IN (SELECT session_id FROM sessions WHERE {_VISIBLE}) GROUP BY 1),
        r AS (SELECT greatest((epoch_us(arg_min(m.ts, m.ordinal)) - epoch_us(any_value(u.ts))) / 1e6, 0) AS gap FROM u JOIN messages m ON m.session_id = u.session_id AND m.role = 'assistant' AND m.ordinal > u.o GROUP BY u.session_id)
        SELECT a.*, b.* FROM (SELECT count(*) AS cycles, round(avg(gap), 4) AS cycle_mean, round(list_sort(list(gap))[least(floor(count(*) * 0.5), count(*) - 1)::BIGINT + 1], 4) AS cycle_p50, round(list_sort(list(gap))[least(floor(count(*) * 0.9::DOUBLE), count(*) - 1)::BIGINT + 1], 4) AS cycle_p90 FROM c) a,
        (SELECT count(*) AS responses, round(avg(gap), 4) AS response_mean, round(list_sort(list(gap))[least(floor(count(*) * 0.5), count(*) - 1)::BIGINT + 1], 4) AS response_p50, round(list_sort(list(gap))[least(floor(count(*) * 0.9::DOUBLE), count(*) - 1)::BIGINT + 1], 4) AS response_p90 FROM r) b"""),
    "analytics_heatmap_sessions": (lambda t: analytics.day_metric(t, "sessions"), _HEAT("sessions", "started_at", "count(m.session_id)")),
    "analytics_heatmap_tokens": (lambda t: analytics.day_metric(t, "output_tokens"), _HEAT("messages", "ts", "coalesce(sum(m.output_tokens), 0)::BIGINT")),
    "analytics_top_by_messages": (lambda t: analytics.top_by(t, "messages"), f" SELECT session_id, project, message_count AS value FROM sessions WHERE {_VISIBLE} ORDER BY value DESC, session_id LIMIT 10"),
    "analytics_top_by_tokens": (lambda t: analytics.top_by(t, "output_tokens"), f" SELECT session_id, project, total_output_tokens AS value FROM sessions WHERE {_VISIBLE} ORDER BY value DESC, session_id LIMIT 10"),
    "analytics_call_times": (_call_times, " SELECT week, category, count(*) AS calls, count(DISTINCT session_id) AS sessions FROM (SELECT c.session_id, category, strftime(date_trunc('week', to_timestamp(t.session_id * 86400 + t.ordinal * 60) AT TIME ZONE 'UTC'), '%Y-%m-%d') AS week FROM calls c LEFT JOIN turns t ON t.session_id = c.session_id AND t.ordinal = c.ordinal WHERE c.session_id IN (SELECT session_id FROM turns)) GROUP BY 1, 2"),
    "stats_cache_spend": (usage.cache_spend, f"{_SURVIVORS} SELECT sum(cost)::BIGINT AS spent, (sum(cost) + sum(savings))::BIGINT AS uncached, sum(savings)::BIGINT AS saved, round(sum(cache_read) / sum(input_tokens + cache_read + cache_creation), 6) AS hit_rate FROM w"),
}
