"""Queries of the activity report over a range of time, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report
from ..sources.tables import Tables
from .reports import _SURVIVORS
from .signals import _SPANS

ZONE = "America/New_York"
_START, _END = "TIMESTAMP '2024-01-01 05:00:00'", "TIMESTAMP '2024-02-01 05:00:00'"
_WITHIN = _SURVIVORS.replace("FROM messages WHERE", f"FROM messages WHERE ts >= {_START} AND ts < {_END} AND")
_CLIPPED = f"{_SPANS}, cs AS (SELECT * FROM (SELECT session_id, is_automated, model, greatest(lo, epoch_us({_START})) AS lo, least(hi, epoch_us({_END})) AS hi FROM spans) WHERE lo < hi)"
_DAYS = f", win AS (SELECT w.s AS s, w.s + INTERVAL 1 DAY AS e FROM (SELECT unnest(generate_series({_START}, {_END} - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS s) w)"
_NAMES = "coalesce(string_agg(DISTINCT model, ',' ORDER BY model) FILTER (model NOT IN ('', 'unknown')), '')"
_SESSIONS = f"""{_CLIPPED}{_WITHIN}, own AS (SELECT session_id, any_value(project) AS project, any_value(agent) AS agent, any_value(is_automated) AS is_automated FROM messages WHERE ts >= {_START} AND ts < {_END} GROUP BY 1),
mm AS (SELECT session_id, model, sum(hi - lo) AS us, min(lo) AS lo, max(hi) AS hi FROM cs GROUP BY 1, 2),
mi AS (SELECT session_id, round(sum(us) / 6e7, 4) AS minutes, min(lo) AS "first", max(hi) AS "last", first(model ORDER BY us DESC, model) FILTER (model NOT IN ('', 'unknown')) AS m, {_NAMES} AS ms FROM mm GROUP BY 1),
cm AS (SELECT session_id, model, sum(cost)::BIGINT AS cost, sum(output_tokens)::BIGINT AS output_tokens FROM w GROUP BY 1, 2),
co AS (SELECT session_id, sum(cost)::BIGINT AS cost, sum(output_tokens)::BIGINT AS output_tokens, first(model ORDER BY greatest(cost, 0) DESC, model) FILTER (model NOT IN ('', 'unknown')) AS c, {_NAMES} AS ks FROM cm GROUP BY 1),
se AS (SELECT session_id, project, agent, is_automated, CASE WHEN minutes IS NULL THEN 'untimed' ELSE 'timed' END AS timing, minutes, "first", "last", coalesce(CASE WHEN m IS NOT NULL THEN m ELSE c END, '') AS primary_model, coalesce(CASE WHEN m IS NOT NULL THEN ms ELSE ks END, '') AS models, coalesce(cost, 0) AS cost, coalesce(output_tokens, 0) AS output_tokens FROM own LEFT JOIN mi USING (session_id) LEFT JOIN co USING (session_id))"""


def _month(t: Tables) -> report.Report:
    return report.resolve(t.messages.sparkSession, "month", "2024-01-15", zone=ZONE)


def ranges(t: Tables) -> DataFrame:
    """The day, week and month of every date with a call, in New York: where they start and end, and the size of their buckets."""
    dates = t.calls.select(F.col("ts").cast("date").alias("date")).distinct().withColumn("preset", F.explode(F.array(*map(F.lit, ("day", "week", "month")))))
    start, end = report.preset_range(F.col("preset"), F.col("date"), ZONE)
    return dates.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "preset", F.unix_micros(start).alias("start"), F.unix_micros(end).alias("end"), report.bucket_seconds(start, end).cast("long").alias("seconds"))


_LOCAL = lambda d: f"epoch_us(timezone('{ZONE}', ({d})::TIMESTAMP))"

QUERIES = {
    "activity_ranges": (ranges, f""", d AS (SELECT DISTINCT ts::DATE AS d FROM calls), p AS (SELECT d, unnest(['day', 'week', 'month']) AS preset FROM d),
        f AS (SELECT d, preset, CASE preset WHEN 'day' THEN d WHEN 'week' THEN date_trunc('week', d)::DATE ELSE date_trunc('month', d)::DATE END AS a, CASE preset WHEN 'day' THEN d + 1 WHEN 'week' THEN date_trunc('week', d)::DATE + 7 ELSE (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE END AS b FROM p),
        g AS (SELECT d, preset, {_LOCAL('a')} AS s, {_LOCAL('b')} AS e FROM f)
        SELECT strftime(d, '%Y-%m-%d') AS date, preset, s AS start, e AS "end", CASE WHEN e - s <= 129600000000 THEN 300 WHEN e - s <= 1209600000000 THEN 3600 WHEN e - s <= 7776000000000 THEN 86400 ELSE 604800 END::BIGINT AS seconds FROM g"""),
    "activity_usage_buckets": (lambda t: report.usage_in_windows(t, _month(t)), f"{_WITHIN} SELECT ((epoch_us(ts) - epoch_us({_START})) // 86400000000)::INTEGER AS \"window\", sum(output_tokens)::BIGINT AS output_tokens, sum(cost)::BIGINT AS cost FROM w GROUP BY 1"),
    "activity_report_buckets": (lambda t: report.buckets(t, _month(t)), f"""{_CLIPPED}{_WITHIN}{_DAYS}, wu AS (SELECT epoch_us(s) AS s, epoch_us(e) AS e FROM win),
        cut AS (SELECT s, greatest(lo, s) AS lo, least(hi, e) AS hi, is_automated::INT AS auto FROM cs JOIN wu ON lo < e AND hi > s),
        net AS (SELECT s, tt, sum(d) AS d, sum(d * auto) AS a FROM (SELECT s, lo AS tt, 1 AS d, auto FROM cut UNION ALL SELECT s, hi, -1, auto FROM cut) GROUP BY 1, 2),
        lv AS (SELECT s, tt, sum(d) OVER o AS open, sum(a) OVER o AS auto FROM net WINDOW o AS (PARTITION BY s ORDER BY tt)),
        pk AS (SELECT s, first(open ORDER BY open DESC, tt) AS open, first(auto ORDER BY open DESC, tt) AS auto FROM lv GROUP BY 1),
        mn AS (SELECT s, round(sum(hi - lo) / 6e7, 4) AS minutes FROM cut GROUP BY 1),
        us AS (SELECT epoch_us({_START}) + (epoch_us(ts) - epoch_us({_START})) // 86400000000 * 86400000000 AS s, sum(output_tokens)::BIGINT AS output_tokens, sum(cost)::BIGINT AS cost FROM w GROUP BY 1)
        SELECT s AS start, e AS "end", coalesce(minutes, 0.0)::DOUBLE AS agent_minutes, coalesce(open, 0)::BIGINT AS max_agents, coalesce(auto, 0)::BIGINT AS automated_at_peak, coalesce(open - auto, 0)::BIGINT AS interactive_at_peak, coalesce(output_tokens, 0) AS output_tokens, coalesce(cost, 0) AS cost
        FROM wu LEFT JOIN mn USING (s) LEFT JOIN pk USING (s) LEFT JOIN us USING (s)"""),
    "activity_report_sessions": (lambda t: report.sessions(t, _month(t)), f"{_SESSIONS} SELECT * FROM se"),
    "activity_report_breakdowns": (lambda t: report.breakdowns(t, _month(t)), f"""{_SESSIONS}, x AS (SELECT session_id, model, us, 0 AS cost FROM mm UNION ALL SELECT session_id, model, 0, cost FROM cm),
        k AS (SELECT unnest(['project', 'agent', 'model']) AS kind, unnest([s.project, s.agent, x.model]) AS label, s.is_automated AS auto, us, cost FROM x JOIN sessions s USING (session_id))
        SELECT kind, label, round(sum(CASE WHEN auto THEN us ELSE 0 END) / 6e7, 4) AS automated_minutes, round(sum(CASE WHEN auto THEN 0 ELSE us END) / 6e7, 4) AS interactive_minutes, sum(CASE WHEN auto THEN cost ELSE 0 END)::BIGINT AS automated_cost, sum(CASE WHEN auto THEN 0 ELSE cost END)::BIGINT AS interactive_cost
        FROM k WHERE label <> '' GROUP BY 1, 2 HAVING (sum(us) <> 0 OR sum(cost) <> 0) AND NOT (kind = 'model' AND label = 'unknown')"""),
    "activity_report_totals": (lambda t: report.totals(t, _month(t)), f"""{_SESSIONS}, net AS (SELECT tt, sum(d) AS d FROM (SELECT lo AS tt, 1 AS d FROM cs UNION ALL SELECT hi, -1 FROM cs) GROUP BY 1), lv AS (SELECT tt, sum(d) OVER (ORDER BY tt) AS open, lead(tt) OVER (ORDER BY tt) AS nxt FROM net),
        sw AS (SELECT round(sum(CASE WHEN open > 0 THEN nxt - tt END) / 6e7, 4) AS active, round(sum(open * (nxt - tt)) / 6e7, 4) AS agent_minutes FROM lv)
        SELECT count(*) AS sessions, count(*) FILTER (is_automated) AS automated, count(*) FILTER (timing = 'untimed') AS untimed, count(DISTINCT project) AS projects, (SELECT count(DISTINCT u) FROM (SELECT unnest(string_split(models, ',')) AS u FROM se WHERE models <> '')) AS models,
        sum(output_tokens)::BIGINT AS output_tokens, sum(cost)::BIGINT AS cost, sum(CASE WHEN is_automated THEN cost ELSE 0 END)::BIGINT AS automated_cost, any_value(active) AS active, any_value(agent_minutes) AS agent_minutes, round((epoch_us({_END}) - epoch_us({_START})) / 6e7 - any_value(active), 4) AS idle FROM se, sw"""),
}
