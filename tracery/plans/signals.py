"""Queries of the quality and concurrency families, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concurrency, quality

_HALF = lambda x: f"(sign({x}) * floor(abs({x}) * 10000 + 0.5) / 10000)"
_RUN = lambda same: f"sum(CASE WHEN call_index > 0 AND {same} THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY call_index)"
_LIKE = "tool_name = lag_tool AND input = lag_input"
_CALLS = """, c1 AS (SELECT *, lag(failed) OVER o AS lag_failed, lag(tool_name) OVER o AS lag_tool, lag(input) OVER o AS lag_input, lag(context_tokens) OVER o AS lag_context FROM calls WINDOW o AS (PARTITION BY session_id ORDER BY call_index)),
fr AS (SELECT session_id, run, failed, count(*) AS n FROM (SELECT session_id, failed, """ + _RUN("failed = lag_failed") + """ AS run FROM c1) GROUP BY 1, 2, 3),
fail AS (SELECT session_id, sum(CASE WHEN failed THEN n ELSE 0 END)::BIGINT AS failures, max(CASE WHEN failed THEN n ELSE 0 END) AS longest, arg_max(CASE WHEN failed THEN n ELSE 0 END, run) AS final_streak FROM fr GROUP BY 1),
lr AS (SELECT *, """ + _RUN(_LIKE) + """ AS run FROM c1),
retry AS (SELECT session_id, sum(CASE WHEN n >= 3 THEN n - 1 ELSE 0 END)::BIGINT AS retries FROM (SELECT session_id, run, count(*) AS n FROM lr GROUP BY 1, 2) GROUP BY 1),
churn AS (SELECT session_id, count(DISTINCT CASE WHEN ordinal - third < 10 THEN file_path END) AS churned FROM (SELECT *, lag(ordinal, 2) OVER (PARTITION BY session_id, file_path ORDER BY call_index) AS third FROM calls WHERE category IN ('Edit', 'Write')) GROUP BY 1),
compact AS (SELECT session_id, count(*) FILTER (context_tokens < 0.7::DOUBLE * lag_context) AS compactions, max(context_tokens) AS peak FROM c1 GROUP BY 1),
w1 AS (SELECT *, count(*) OVER r AS rn, sum(failed::INT) OVER r AS rf, count(*) OVER t AS tn, sum(failed::INT) OVER t AS tf, list(category) OVER t AS own FROM lr WINDOW r AS (PARTITION BY session_id, run ORDER BY call_index), t AS (PARTITION BY session_id ORDER BY call_index ROWS 11 PRECEDING)),
runaway AS (SELECT session_id, bool_or((rn >= 5 AND rf >= 3) OR (tn = 12 AND (tf >= 6 OR (tf >= 3 AND list_max(list_transform(list_distinct(own), lambda x: len(list_filter(own, lambda y: y = x)))) >= 10)))) AND count(*) >= 12 AS runaway FROM w1 GROUP BY 1),
sig AS (SELECT session_id, failures, longest, final_streak, retries, coalesce(churned, 0) AS churned, coalesce(compactions, 0) AS compactions, runaway FROM fail JOIN retry USING (session_id) LEFT JOIN churn USING (session_id) LEFT JOIN compact USING (session_id) JOIN runaway USING (session_id)),
scored AS (SELECT *, greatest(100 - (CASE WHEN final_streak >= 3 THEN 30 ELSE 0 END + least(failures * 3, 30) + least(retries * 5, 25) + least(churned * 4, 20) + CASE WHEN longest >= 3 THEN 10 ELSE 0 END + CASE WHEN compactions >= 2 THEN least((compactions - 1) * 5, 15) ELSE 0 END + CASE WHEN runaway THEN 5 ELSE 0 END), 0)::INT AS score FROM sig),
graded AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM scored)"""
_SPANS = """, r1 AS (SELECT *, epoch_us(ts) AS tt, lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ordinal) AS lo FROM messages),
spans AS (SELECT session_id, project, agent, is_automated, lo, least(tt, lo + 300000000) AS hi, coalesce(last_value(CASE WHEN role = 'assistant' THEN model END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING), '') AS model FROM r1 WHERE tt > lo)"""
_SWEEP = """, net AS (SELECT tt, sum(d) AS d FROM (SELECT lo AS tt, 1 AS d FROM spans UNION ALL SELECT hi, -1 FROM spans) GROUP BY 1), lv AS (SELECT tt, sum(d) OVER (ORDER BY tt) AS open, lead(tt) OVER (ORDER BY tt) AS nxt FROM net)"""
_CUT = """, cut AS (SELECT b, greatest(lo, b * 3600000000) AS lo, least(hi, (b + 1) * 3600000000) AS hi FROM (SELECT *, unnest(generate_series(lo // 3600000000, (hi - 1) // 3600000000)) AS b FROM spans))"""
_KEYS = """, k AS (SELECT kind, label, round(sum(CASE WHEN is_automated THEN us ELSE 0 END) / 6e7, 4) AS automated, round(sum(CASE WHEN is_automated THEN 0 ELSE us END) / 6e7, 4) AS interactive FROM (SELECT is_automated, hi - lo AS us, unnest(['project', 'agent', 'model']) AS kind, unnest([project, agent, model]) AS label FROM spans) GROUP BY 1, 2)"""
_PROMPTS = """, p1 AS (SELECT session_id, ordinal, content, trim(regexp_replace(lower(regexp_replace(content, '(?s)```.*?```', ' ', 'g')), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS norm FROM turns WHERE role = 'user' AND NOT is_system),
p2 AS (SELECT *, list_filter(regexp_split_to_array(norm, '[^a-z0-9]+'), lambda w: length(w) >= 3) AS tokens FROM p1)"""
_LAST = """, l AS (SELECT session_id, arg_max(role, ordinal) AS last_role, count(*) AS n, max(ts) AS last, bool_or(is_automated) AS auto, arg_max(event_type, ordinal) AS last_type FROM messages GROUP BY 1),
o AS (SELECT session_id, CASE WHEN auto THEN 'unknown/low' WHEN last_role = 'assistant' AND last_type = 'error' THEN CASE WHEN fresh THEN 'unknown/low' ELSE 'errored/medium' END WHEN n = 2 AND last_role = 'assistant' THEN 'completed/medium' WHEN n < 3 OR fresh THEN 'unknown/low' WHEN last_role = 'user' AND n >= 10 THEN 'abandoned/high' WHEN last_role = 'user' THEN 'abandoned/medium' ELSE 'completed/medium' END AS o FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-30 23:00:00') - epoch_us(last) < 600000000 AS fresh FROM l))"""

QUERIES = {
    "quality_failures": (lambda t: quality.failures(t.calls), f"{_CALLS} SELECT * FROM fail"),
    "quality_retries": (lambda t: quality.retries(t.calls), f"{_CALLS} SELECT * FROM retry"),
    "quality_edit_churn": (lambda t: quality.edit_churn(t.calls), f"{_CALLS} SELECT * FROM churn"),
    "quality_compactions": (lambda t: quality.compactions(t.calls), f"{_CALLS} SELECT * FROM compact"),
    "quality_runaway": (lambda t: quality.runaway(t.calls), f"{_CALLS} SELECT * FROM runaway"),
    "quality_signals": (quality.call_signals, f"{_CALLS} SELECT * FROM graded"),
    "quality_grades": (quality.grade_distribution, f"{_CALLS} SELECT grade, count(*) AS sessions, round(avg(score), 4) AS mean_score FROM graded GROUP BY 1"),
    "quality_worst_sessions": (quality.worst_sessions, f"{_CALLS} SELECT session_id, failures AS value FROM graded ORDER BY value DESC, session_id LIMIT 10"),
    "quality_dominant_models": (quality.dominant_models, ", n AS (SELECT session_id, model, count(*) AS n, min(ordinal) AS f FROM messages WHERE role = 'assistant' GROUP BY 1, 2) SELECT session_id, model FROM n QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, f) = 1"),
    "quality_pressure": (quality.pressure, ", n AS (SELECT session_id, model, count(*) AS n, min(ordinal) AS f FROM messages WHERE role = 'assistant' GROUP BY 1, 2), d AS (SELECT session_id, model FROM n QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, f) = 1) SELECT session_id, round(peak_context_tokens / CASE model WHEN 'm0' THEN 200000 WHEN 'm1' THEN 1000 WHEN 'm2' THEN 800 END, 6) AS pressure FROM d JOIN sessions USING (session_id)"),
    "quality_outcomes": (lambda t: quality.outcomes(t, "2024-01-30 23:00:00"), f"{_LAST} SELECT session_id, split_part(o, '/', 1) AS outcome, split_part(o, '/', 2) AS confidence FROM o"),
    "quality_prompts": (lambda t: quality.prompts(t).select("session_id", "ordinal", "norm", F.array_join("tokens", " ").alias("tokens")), f"{_PROMPTS} SELECT session_id, ordinal, norm, array_to_string(tokens, ' ') AS tokens FROM p2"),
    "quality_prompt_flags": (quality.prompt_flags, f"{_PROMPTS} SELECT session_id, arg_min(strlen(content), ordinal) AS first_bytes, arg_min(strlen(content), ordinal) < 30 AS short_start, count(*) FILTER (NOT regexp_matches(content, '[0-9/]')) AS no_reference FROM p2 GROUP BY 1"),
    "quality_duplicate_prompts": (quality.duplicate_prompts, None),
    "quality_frustration": (quality.frustration, ", f AS (SELECT session_id, content, list_filter(regexp_split_to_array(regexp_replace(content, '(?s)```.*?```', ' ', 'g'), '[ \\t\\n]+'), lambda w: regexp_full_match(w, '[A-Za-z]{2,}')) AS w FROM turns WHERE role = 'user') SELECT session_id, count(*) FILTER (contains(content, '!!!') OR (len(w) > 0 AND len(list_filter(w, lambda x: x = upper(x))) >= 0.4::DOUBLE * len(w))) AS markers FROM f GROUP BY 1"),
    "activity_intervals": (concurrency.intervals, f"{_SPANS} SELECT * FROM spans"),
    "activity_concurrency": (concurrency.concurrency, f"{_SPANS}{_SWEEP} SELECT max(open)::BIGINT AS peak, (SELECT min(tt) FROM lv WHERE open = (SELECT max(open) FROM lv)) AS peak_at, round(sum(CASE WHEN open > 0 THEN nxt - tt END) / 6e7, 4) AS active_minutes FROM lv"),
    "activity_buckets": (concurrency.bucket_metrics, f"{_SPANS}{_CUT}, n AS (SELECT b, tt, sum(d) AS d FROM (SELECT b, lo AS tt, 1 AS d FROM cut UNION ALL SELECT b, hi, -1 FROM cut) GROUP BY 1, 2), p AS (SELECT b, max(o) AS m FROM (SELECT b, sum(d) OVER (PARTITION BY b ORDER BY tt) AS o FROM n) GROUP BY 1) SELECT b AS hour, round(sum(hi - lo) / 6e7, 4) AS minutes, any_value(m)::BIGINT AS most FROM cut JOIN p USING (b) GROUP BY 1"),
    "activity_sessions": (concurrency.by_session, f"{_SPANS}, m AS (SELECT session_id, model, sum(hi - lo) AS us FROM spans GROUP BY 1, 2) SELECT session_id, round(sum(us) / 6e7, 4) AS minutes, first(model ORDER BY us DESC, model) AS model FROM m GROUP BY 1"),
    "activity_breakdowns": (concurrency.by_key, f"{_SPANS}{_KEYS} SELECT * FROM k"),
    "activity_totals": (concurrency.totals, f"{_SPANS} SELECT round(sum(hi - lo) / 6e7, 4) AS agent_minutes, count(DISTINCT session_id) AS sessions, count(DISTINCT project) AS projects, count(DISTINCT nullif(model, '')) AS models FROM spans"),
    "activity_candidates": (concurrency.candidates, " SELECT session_id FROM sessions WHERE started_at < TIMESTAMP '2024-01-10' AND ended_at >= TIMESTAMP '2024-01-08'"),
    "activity_listing": (concurrency.listing, f"{_SPANS} SELECT session_id, lo // 1000000 AS lo, hi // 1000000 AS hi, model FROM spans"),
    "activity_first_seen": (concurrency.first_seen, ", f AS (SELECT 'sessions' AS kind, min(ts) AS t FROM messages GROUP BY session_id UNION ALL SELECT 'projects', min(ts) FROM messages GROUP BY project UNION ALL SELECT 'models', min(ts) FROM messages WHERE model <> '' GROUP BY model) SELECT strftime(date_trunc('hour', t), '%Y-%m-%d %H') AS hour, kind, count(*) AS n FROM f GROUP BY 1, 2"),
    "activity_strip_laddered": (lambda t: concurrency.laddered_strip(t.messages.withColumns({"is_system": F.col("event_id") % 13 == 0, "ts": F.when(F.col("event_id") % 19 != 0, F.col("ts"))})), """, vm AS (SELECT session_id, ordinal, role, epoch_us(ts) AS tm FROM messages WHERE event_id % 13 <> 0 AND event_id % 19 <> 0), e0 AS (SELECT session_id, min(tm) AS lo, max(tm) AS hi, (max(tm) - min(tm)) // 1000000 AS d FROM vm GROUP BY 1),
e1 AS (SELECT *, CASE WHEN d // 30 <= 60 THEN 60 ELSE (SELECT w FROM (VALUES (60), (120), (300), (600), (900), (1800), (3600), (7200)) v(w) ORDER BY abs(w - d // 30), w DESC LIMIT 1) END AS b FROM e0), e2 AS (SELECT *, (CASE WHEN d // b + 1 > 50 THEN (d + 48) // 49 ELSE b END)::BIGINT AS seconds FROM e1),
sp AS (SELECT session_id, seconds, unnest(generate_series(0, (hi - lo) // (seconds * 1000000))) AS i FROM e2), n AS (SELECT session_id, (tm - lo) // (seconds * 1000000) AS i, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, min(ordinal) AS first_ordinal FROM vm JOIN e2 USING (session_id) GROUP BY 1, 2)
SELECT session_id, seconds, i, coalesce(u, 0) AS "user", coalesce(a, 0) AS assistant, first_ordinal FROM sp LEFT JOIN n USING (session_id, i)"""),
    "activity_strip": (concurrency.strip, ", e AS (SELECT *, greatest(ceil((hi - lo + 1) / 30.0::DOUBLE), 1)::BIGINT AS step FROM (SELECT session_id, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM messages GROUP BY 1)), s AS (SELECT session_id, unnest(generate_series(0, (hi - lo) // step)) AS i FROM e), n AS (SELECT session_id, (epoch_us(ts) - lo) // step AS i, count(*) AS messages, min(ordinal) AS first_ordinal FROM messages JOIN e USING (session_id) GROUP BY 1, 2) SELECT session_id, i, coalesce(messages, 0) AS messages, first_ordinal FROM s LEFT JOIN n USING (session_id, i)"),
    "activity_turns": (concurrency.turns, ", u AS (SELECT session_id, ordinal, ts, lead(ts) OVER (PARTITION BY session_id ORDER BY ordinal) AS nxt FROM messages WHERE role = 'user') SELECT session_id, ordinal, CASE WHEN coalesce(nxt, ended_at) >= ts THEN epoch_us(coalesce(nxt, ended_at)) - epoch_us(ts) END AS micros FROM u JOIN sessions USING (session_id)"),
    "activity_digest": (concurrency.digest, f"{_SPANS}{_KEYS} SELECT kind, label, row_number() OVER (PARTITION BY kind ORDER BY automated + interactive DESC, label) AS place FROM k QUALIFY place <= 3"),
}
