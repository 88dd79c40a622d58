"""Queries of the signals page over the signal job's sessions, with SQL oracles. Agents, projects and days go by the sessions' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rollup
from ..sources.tables import Tables
from . import job

def s():
    return F.col("session_id")


def _signals(t: Tables) -> DataFrame:
    return job.job(t).withColumns({"agent": F.concat(F.lit("a"), (s() % 3).cast("string")), "project": F.concat(F.lit("p"), (s() % 5).cast("string")), "day": F.date_add(F.lit("2024-01-01").cast("date"), (s() % 7).cast("int"))})


_NAMES = rollup.COUNTED + rollup.FLAGS
_JOB = f"{job._ALL}, sj AS ({job.QUERIES['quality_signal_job'][1][len(job._ALL):]}), sg AS (SELECT * REPLACE ({', '.join(f'coalesce({n}::BIGINT, 0) AS {n}' for n in _NAMES)}), 'a' || session_id % 3 AS agent, 'p' || session_id % 5 AS project, (DATE '2024-01-01' + (session_id % 7)::INT)::VARCHAR AS day FROM sj)"
_TOLD = ", ".join(
    ["count(*) AS sessions", "count(score) AS scored", "round(avg(score), 4) AS mean_score"] + [f"count(*) FILTER (grade = '{g}') AS grade_{g.lower()}" for g in "ABCDF"]
    + [f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("completed", "abandoned", "errored", "unknown")] + [f"sum({n})::BIGINT AS {n}" for n in _NAMES] + [f"count(*) FILTER ({n} > 0) AS with_{n}" for n in _NAMES]
)
_VIEWS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {c} AS label, {_TOLD} FROM sg GROUP BY {c}" for k, c in (("all", "''"), ("agent", "agent"), ("project", "project"), ("day", "day")))
_LONG = "ul AS (" + " UNION ALL ".join(f"SELECT '{n}' AS signal, session_id, {n} AS value, score, outcome FROM sg" for n in _NAMES) + ")"
_BAD = "avg(CASE WHEN outcome <> 'unknown' THEN (outcome IN ('abandoned', 'errored'))::INT END) FILTER (value {0})"

QUERIES = {
    "analytics_signals": (lambda t: rollup.distributions(_signals(t)), f"{_JOB} {_VIEWS}"),
    "analytics_signal_calibration": (lambda t: rollup.calibration(_signals(t)), f"""{_JOB}, {_LONG}, cb AS (SELECT signal, count(*) FILTER (value > 0) AS having, count(*) FILTER (value = 0) AS lacking, avg(score) FILTER (value > 0) AS s1, avg(score) FILTER (value = 0) AS s0, {_BAD.format('> 0')} AS b1, {_BAD.format('= 0')} AS b0 FROM ul GROUP BY 1)
  SELECT signal, having, lacking, round(s1, 4) AS score_having, round(s0, 4) AS score_lacking, round(b1, 6) AS bad_having, round(b0, 6) AS bad_lacking, CASE WHEN b0 > 0 THEN round(b1 / b0, 6) END AS lift FROM cb""".replace("AS having", 'AS "having"').replace("signal, having,", 'signal, "having",')),
    "analytics_signal_sessions": (lambda t: rollup.shown_by(_signals(t), t.turns), f"{_JOB}, {_LONG}, fm AS (SELECT session_id, min(ordinal) AS ordinal, arg_min(content, ordinal) AS content FROM turns WHERE role = 'user' AND NOT is_system GROUP BY 1), tp AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY value DESC, session_id) AS place FROM ul WHERE value > 0 QUALIFY place <= 10) SELECT signal, place, session_id, value, ordinal, substr(content, 1, 160) AS excerpt FROM tp LEFT JOIN fm USING (session_id)"),
}
