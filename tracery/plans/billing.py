"""Queries of the whole cost union: messages, usage events and billing rows, filtered after snapshots are chosen; with SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import usage
from ..sources.tables import Tables


def _union(t: Tables) -> DataFrame:
    """Messages with web searches; signups as usage events, some with a reported cost, some without a time; every 50th view as a billing row."""
    E = F.col("event_id")  # noqa: N806
    searched = t.messages.withColumn("web_searches", F.when(E % 23 == 0, 2).otherwise(0))
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (E % len(values) + 1).cast("int"))
    events = t.messages.where("event_type = 'signup'").select(
        "session_id", F.when(E % 2 == 0, F.col("ordinal")).alias("ordinal"), pick("session", "event", "sidecar").alias("source"), F.concat(F.lit("m"), (E % 4).cast("string")).alias("model"),
        (E % 1200 - 50).alias("input_tokens"), F.when(E % 5 == 0, 0).otherwise((E * 7919) % 3_000_000).alias("output_tokens"), (E % 70).alias("cache_creation"), (E % 90).alias("cache_read"), (E % 40).alias("reasoning_tokens"),
        F.when(E % 4 == 0, E % 10_000).alias("reported"), F.when(E % 8 == 0, "copilot-reported").otherwise("").alias("cost_source"), F.when(E % 6 != 0, F.col("ts")).alias("ts"), F.when(E % 3 == 0, F.concat(F.lit("k"), F.floor(E / 9).cast("string"))).otherwise("").alias("dedup_key"),
    )
    standalone = t.messages.where("event_type = 'view' and event_id % 50 = 0").select("ts", F.lit("m1").alias("model"), *((E % n).alias(c) for c, n in zip(usage.COUNTS, (500, 300, 20, 10), strict=True)), F.concat(F.lit("c"), F.floor(E / 200).cast("string")).alias("dedup_key"), F.lit(False).alias("is_automated"))
    return usage.union_rows(searched, events, standalone, t.sessions)


def _told(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "model", "agent").agg(F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(c) for c in (*usage.COUNTS, "web_searches")), F.sum(F.unix_micros("ts") % 1_000_003).alias("ts_sum"))


def _costs(rows: DataFrame) -> DataFrame:
    return usage.priced(usage.one_of_each(rows)).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), "source", "model").agg(F.count(F.lit(1)).alias("rows"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.sum("savings").alias("savings"))


def union(t: Tables) -> DataFrame:
    return _told(_union(t))


def costs(t: Tables) -> DataFrame:
    return _costs(usage.surviving_snapshots(_union(t)))


def filtered(t: Tables) -> DataFrame:
    kept = usage.usage_filter(usage.surviving_snapshots(_union(t)), not_models=["m3"], not_agents=["a2"], not_projects=["p4"], machines=["h0", "h1", "h2"], min_user=2, one_shots=False, scope="human", active=t.sessions.where("ended_at >= timestamp'2024-01-05'"))
    return _costs(kept)


def by_model(t: Tables) -> DataFrame:
    return _costs(usage.usage_filter(usage.surviving_snapshots(_union(t)), models=["m0", "m1"], agents=["a1", "cursor"]))


def branches(t: Tables) -> DataFrame:
    return _costs(usage.usage_filter(usage.surviving_snapshots(_union(t)), branches=[("p1", "b1"), ("p2", "b0")], scope="automated"))


_CLAMP = lambda c: f"least(greatest({c}, 0), 2000000)"
_COUNTS = ("input_tokens", "output_tokens", "cache_creation", "cache_read")
_UNION = f""", ev AS (SELECT session_id, CASE WHEN event_id % 2 = 0 THEN ordinal END AS ordinal, ['session', 'event', 'sidecar'][event_id % 3 + 1] AS source, CASE WHEN event_id % 6 <> 0 THEN ts END AS ts, 'm' || (event_id % 4) AS model, event_id % 1200 - 50 AS input_tokens, CASE WHEN event_id % 5 = 0 THEN 0 ELSE (event_id * 7919) % 3000000 END AS output_tokens, event_id % 70 AS cache_creation, event_id % 90 AS cache_read,
  event_id % 40 AS reasoning, CASE WHEN event_id % 4 = 0 THEN event_id % 10000 END AS reported, CASE WHEN event_id % 8 = 0 THEN 'copilot-reported' ELSE '' END AS cost_source, CASE WHEN event_id % 3 = 0 THEN 'k' || (event_id // 9) ELSE '' END AS dedup_key FROM messages WHERE event_type = 'signup'),
ux AS (SELECT session_id, ordinal, 'message' AS source, ts, model, {', '.join(f'{_CLAMP(c)} AS {c}' for c in _COUNTS)}, 0 AS reasoning, CASE WHEN event_id % 23 = 0 THEN 2 ELSE 0 END AS web, NULL::BIGINT AS reported, '' AS cost_source, message_id, request_id, source_uuid, '' AS dedup_key FROM messages WHERE role = 'assistant' AND model <> ''
  UNION ALL SELECT session_id, ordinal, source, ts, model, {', '.join(f"CASE WHEN source = 'session' THEN greatest({c}, 0) ELSE {_CLAMP(c)} END" for c in _COUNTS)}, reasoning, 0, reported, cost_source, '', '', '', dedup_key FROM ev),
un AS (SELECT ux.session_id, ordinal, source, coalesce(ts, started_at) AS ts, model, {', '.join(_COUNTS)}, reasoning, web, reported, cost_source, message_id, request_id, source_uuid, dedup_key, project, agent, machine, branch, is_automated, user_message_count FROM ux JOIN sessions USING (session_id)
  UNION ALL SELECT '', NULL, 'billing', ts, 'm1', event_id % 500, event_id % 300, event_id % 20, event_id % 10, 0, 0, NULL, '', '', '', '', 'c' || (event_id // 200), '', 'cursor', '', '', false, 0 FROM messages WHERE event_type = 'view' AND event_id % 50 = 0)"""
_OWNER = ("session_id", "project", "agent", "machine", "branch", "is_automated", "user_message_count")
_SNAP = f""", sr AS (SELECT *, row_number() OVER (PARTITION BY message_id, request_id ORDER BY output_tokens DESC, ts DESC NULLS LAST, session_id DESC, coalesce(ordinal, -1) DESC) AS turn, max(web) OVER (PARTITION BY message_id, request_id) AS most, {', '.join(f'first_value({c}) OVER o AS o_{c}' for c in _OWNER)} FROM un WHERE message_id <> '' AND request_id <> '' WINDOW o AS (PARTITION BY message_id, request_id ORDER BY ts NULLS LAST, session_id, coalesce(ordinal, -1))),
sv AS (SELECT {', '.join(f'o_{c} AS {c}' for c in _OWNER)}, ordinal, source, ts, model, {', '.join(_COUNTS)}, reasoning, most AS web, reported, cost_source, message_id, request_id, source_uuid, dedup_key FROM sr WHERE turn = 1
  UNION ALL SELECT {', '.join(_OWNER)}, ordinal, source, ts, model, {', '.join(_COUNTS)}, reasoning, web, reported, cost_source, message_id, request_id, source_uuid, dedup_key FROM un WHERE message_id = '' OR request_id = '')"""
_COST = lambda where: f""", fl AS (SELECT *, CASE WHEN message_id <> '' AND request_id <> '' THEN 'r|' || message_id || '|' || request_id WHEN source = 'message' AND agent <> '' AND source_uuid <> '' THEN 'u|' || agent || '|' || source_uuid WHEN dedup_key <> '' THEN 'k|' || dedup_key END AS token FROM sv WHERE {where}),
dd AS (SELECT * FROM fl WHERE token IS NOT NULL QUALIFY row_number() OVER (PARTITION BY token ORDER BY ts NULLS LAST, session_id, coalesce(ordinal, -1), {', '.join(_COUNTS)}) = 1 UNION ALL SELECT * FROM fl WHERE token IS NULL),
pc AS (SELECT *, CASE WHEN output_tokens = 0 THEN reasoning ELSE output_tokens END AS b, model = 'm0' AND (source = 'message' OR ordinal IS NOT NULL) AND input_tokens + cache_read + cache_creation > 900 AS big FROM dd),
rt AS (SELECT pc.*, CASE WHEN model = 'm0' THEN CASE WHEN big THEN 6000000 ELSE 3000000 END WHEN model = 'm1' THEN 800000 END AS ri, CASE WHEN model = 'm0' THEN CASE WHEN big THEN 22500000 ELSE 15000000 END WHEN model = 'm1' THEN 4000000 END AS ro, CASE WHEN model = 'm0' THEN CASE WHEN big THEN 7500000 ELSE 3750000 END WHEN model = 'm1' THEN 1000000 END AS rc, CASE WHEN model = 'm0' THEN CASE WHEN big THEN 600000 ELSE 300000 END WHEN model = 'm1' THEN 80000 END AS rr FROM pc),
ct AS (SELECT *, CASE WHEN reported IS NOT NULL AND cost_source <> 'copilot-reported' THEN reported ELSE coalesce(((input_tokens::HUGEINT * ri + b::HUGEINT * ro + cache_creation::HUGEINT * rc + cache_read::HUGEINT * rr + 500000) // 1000000)::BIGINT, 0) + 10000 * web END AS cost, coalesce((cache_read * (ri - rr) + cache_creation * (ri - rc))::BIGINT, 0) AS s6 FROM rt)
SELECT strftime(ts, '%Y-%m-%d') AS date, source, model, count(*) AS rows, sum(output_tokens)::BIGINT AS output_tokens, sum(cost)::BIGINT AS cost, sum(sign(s6) * ((abs(s6) + 500000) // 1000000))::BIGINT AS savings FROM ct GROUP BY 1, 2, 3"""  # noqa: E731

QUERIES = {
    "usage_union": (union, f"{_UNION} SELECT source, model, agent, count(*) AS rows, {', '.join(f'sum({c})::BIGINT AS {c}' for c in _COUNTS)}, sum(web)::BIGINT AS web_searches, sum(epoch_us(ts) % 1000003)::BIGINT AS ts_sum FROM un GROUP BY 1, 2, 3"),
    "usage_costs": (costs, f"{_UNION}{_SNAP}{_COST('true')}"),
    "usage_filtered": (filtered, f"{_UNION}{_SNAP}" + _COST("session_id <> '' AND model <> 'm3' AND agent <> 'a2' AND project <> 'p4' AND machine IN ('h0', 'h1', 'h2') AND user_message_count >= 2 AND user_message_count > 1 AND NOT is_automated AND session_id IN (SELECT session_id FROM sessions WHERE ended_at >= TIMESTAMP '2024-01-05')")),
    "usage_filtered_models": (by_model, f"{_UNION}{_SNAP}" + _COST("model IN ('m0', 'm1') AND agent IN ('a1', 'cursor')")),
    "usage_filtered_branches": (branches, f"{_UNION}{_SNAP}" + _COST("session_id <> '' AND ((project = 'p1' AND branch = 'b1') OR (project = 'p2' AND branch = 'b0')) AND is_automated")),
}
