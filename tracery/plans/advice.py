"""Queries of the coaching and retrieval families, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coach
from ..operators.quality import call_facts
from ..sources.tables import Tables
from . import job
from .signals import _CALLS, _HALF

_FIRST = ", p AS (SELECT session_id, trim(arg_min(content, ordinal)) AS prompt FROM turns WHERE role = 'user' AND NOT is_system GROUP BY 1)"
_ANY = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"
_BREAKS = "(length(prompt) - length(replace(prompt, chr(10), '')))"
_DIMS = ", ".join(f"CASE WHEN {_ANY('lower(prompt)', w)} THEN 100 ELSE 0 END AS {k}" for k, w in coach.DIMENSIONS.items())
_INTENT = "CASE " + " ".join(f"WHEN {_ANY('lower(prompt)', w)} THEN '{k}'" for k, w in coach.INTENTS.items()) + " ELSE 'Planning' END"
_WORDS = lambda col: f"list_distinct(list_filter(regexp_split_to_array(lower({col}), '[^a-z0-9_]+'), lambda w: length(w) >= 2))"


def _boundaries(t: Tables):
    return t.calls.where("context_tokens % 7 = 0").select("session_id", F.col("call_index").alias("ordinal"))


def _billing(t: Tables):
    return t.messages.where("event_id % 3 = 0").select(F.when(F.col("event_id") % 2 == 0, (F.col("event_id") / 6).cast("long").cast("string")).otherwise("").alias("dedup_key"), F.date_trunc("week", "ts").alias("ts"), F.lit("billed").alias("model"), F.lit(5).alias("output_tokens"))


def _entries(t: Tables):
    return t.turns.where("role = 'assistant'").select(F.concat_ws("-", "session_id", "ordinal").alias("key"), F.col("content").alias("text"), F.lit("evidence tion_2").alias("evidence"), (F.col("ordinal") % 4 / 4).alias("confidence"))


def _asked(t: Tables):
    """Every user turn."""
    return t.turns.where("role = 'user'").select(F.concat_ws("-", "session_id", "ordinal").alias("query"), F.col("content").alias("text"))


def _asked_by_id(t: Tables):
    """Every user turn of the sessions whose id is divisible by 20."""
    return _asked(t._replace(turns=t.turns.where("session_id % 20 = 0")))


#: Prompts that recur: two thirds of the sessions begin with one of these, with a number now and then.
ROUTINE = ["Please fix the login bug in the parser", "fix the Login bug in the parser now", "run all tests and report failures", "Run all tests, and report failures again please", "update dependencies; must check the changelog\n- first\n- second\n- third", "plan", "continue to iterate on it", "explain `parse` in src/app.py"]


def _sessions(t: Tables):
    """session_id, project and first prompt of text sessions."""
    own = coach.first_prompts(t.turns)
    s = F.col("session_id")
    routine = F.concat(F.element_at(F.array(*map(F.lit, ROUTINE)), (s % len(ROUTINE) + 1).cast("int")), F.when(s % 5 == 0, F.concat(F.lit(" "), s.cast("string"))).otherwise(""))
    return own.select("session_id", F.concat(F.lit("p"), (s % 4).cast("string")).alias("project"), F.when(s % 3 == 0, F.col("prompt")).otherwise(F.trim(routine)).alias("prompt"))


def _worked(t: Tables):
    """The same with what their calls tell."""
    facts = call_facts(job.calls(t)).select("session_id", "failures", "churned", "calls", "peak")
    out = _sessions(t).join(facts, "session_id", "left").na.fill(0, ["failures", "churned", "calls"])
    return out.withColumn("has_context", (F.col("calls") > 0) | F.col("peak").isNotNull())


_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for w in words) + "]"
_STOPS = _LIST(coach.STOP)
_SESSIONS = f"{_FIRST}, cs AS (SELECT session_id, 'p' || (session_id % 4) AS project, CASE WHEN session_id % 3 = 0 THEN prompt ELSE trim({_LIST(ROUTINE)}[session_id % {len(ROUTINE)} + 1] || CASE WHEN session_id % 5 = 0 THEN ' ' || session_id ELSE '' END) END AS prompt FROM p)"
_WORKED = f"{job._JCALLS}{job._FACTS}{_SESSIONS}, cw AS (SELECT session_id, prompt, coalesce(failures, 0) AS failures, coalesce(churned, 0) AS churned, coalesce(calls, 0) AS calls, coalesce(calls, 0) > 0 OR peak IS NOT NULL AS has_context FROM cs LEFT JOIN ff USING (session_id) LEFT JOIN fc USING (session_id) LEFT JOIN fp USING (session_id))"
_GRADED = f""", gd AS (SELECT session_id, {_DIMS}, least(CASE WHEN has_context THEN 50 ELSE 0 END + CASE WHEN contains(prompt, '`') OR contains(prompt, chr(10)) THEN 30 ELSE 0 END + CASE WHEN {_BREAKS} >= 2 THEN 20 ELSE 0 END, 100) AS context, least(CASE WHEN length(prompt) >= 100 THEN 40 WHEN length(prompt) >= 50 THEN 20 ELSE 0 END + CASE WHEN contains(prompt, chr(10) || '- ') OR contains(prompt, chr(10) || '* ') THEN 30 ELSE 0 END + CASE WHEN {_BREAKS} >= 3 THEN 30 ELSE 0 END, 100) AS specificity FROM cw),
  gt AS (SELECT *, ((constraints + success + verification + context + specificity) // 5)::INT AS total FROM gd),
  gp AS (SELECT *, CASE WHEN total >= 90 THEN 'A' WHEN total >= 75 THEN 'B' WHEN total >= 60 THEN 'C' WHEN total >= 40 THEN 'D' ELSE 'F' END AS grade, array_to_string(list_filter([CASE WHEN constraints = 0 THEN 'No constraints specified' END, CASE WHEN success = 0 THEN 'No success criteria' END, CASE WHEN verification = 0 THEN 'No verification steps' END, CASE WHEN context = 0 THEN 'No context provided' END, CASE WHEN specificity = 0 THEN 'Very short or vague prompt' END], lambda x: x IS NOT NULL), '; ') AS issues FROM gt)"""
_TOLD = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9_]+'), lambda w: w <> '' AND NOT list_contains({_STOPS}, w))"
_BOOSTED = f""", e AS (SELECT session_id || '-' || ordinal AS key, content, {_WORDS('content')} AS w, (ordinal % 4) / 4.0::DOUBLE AS confidence FROM turns WHERE role = 'assistant'), ps AS (SELECT DISTINCT key, confidence, unnest(list_distinct(list_concat(w, ['evidence', 'tion_2']))) AS w FROM e),
  q AS (SELECT session_id || '-' || ordinal AS query, content FROM turns WHERE role = 'user' AND session_id % 20 = 0), a AS (SELECT query, unnest({_WORDS('content')}) AS w FROM q), df AS (SELECT w, count(*)::DOUBLE AS df FROM ps WHERE w IN (SELECT w FROM a) GROUP BY 1),
  i AS (SELECT w, ln(1 + ((SELECT count(*) FROM e) - df + 0.5) / (df + 0.5)) + 1 + CASE WHEN regexp_matches(w, '[_0-9]') THEN 2.0 ELSE 0.0 END AS idf FROM df),
  qt AS (SELECT query, {_TOLD('content')} AS t FROM q), et AS (SELECT key, {_TOLD('content')} AS t FROM e), sz AS (SELECT unnest([3, 4, 5]) AS n),
  ap AS (SELECT DISTINCT query, n, unnest(list_transform(generate_series(1, len(t) - n + 1), lambda j: array_to_string(t[j:j + n - 1], ' '))) AS p FROM qt, sz WHERE len(t) >= n), ep AS (SELECT DISTINCT key, unnest(list_transform(generate_series(1, len(t) - n + 1), lambda j: array_to_string(t[j:j + n - 1], ' '))) AS p FROM et, sz WHERE len(t) >= n),
  an AS (SELECT * FROM (SELECT query, unnest(list_distinct(regexp_split_to_array(lower(content), '[^a-z0-9_./-]+'))) AS e FROM q) WHERE length(e) >= 3), en AS (SELECT * FROM (SELECT key, unnest((list_sort(w))[1:2]) AS e FROM e) WHERE length(e) >= 3),
  ea AS (SELECT key, confidence, split_part(key, '-', 1)::BIGINT * 3600 + split_part(key, '-', 2)::BIGINT AS made FROM e), ec AS (SELECT key, confidence, (made - (SELECT min(made) FROM ea))::DOUBLE / ((SELECT max(made) FROM ea) - (SELECT min(made) FROM ea)) AS recent FROM ea)"""

QUERIES = {
    "coach_maturity": (lambda t: coach.maturity(t.turns), f"{_FIRST}, d AS (SELECT session_id, {_DIMS}, CASE WHEN contains(prompt, '`') OR contains(prompt, chr(10)) THEN 30 ELSE 0 END + CASE WHEN {_BREAKS} >= 2 THEN 20 ELSE 0 END AS context, CASE WHEN length(prompt) >= 100 THEN 40 WHEN length(prompt) >= 50 THEN 20 ELSE 0 END + CASE WHEN contains(prompt, chr(10) || '- ') OR contains(prompt, chr(10) || '* ') THEN 30 ELSE 0 END + CASE WHEN {_BREAKS} >= 3 THEN 30 ELSE 0 END AS specificity FROM p), e AS (SELECT *, (constraints + success + verification + context + specificity) // 5 AS total FROM d) SELECT *, CASE WHEN total >= 90 THEN 'A' WHEN total >= 75 THEN 'B' WHEN total >= 60 THEN 'C' WHEN total >= 40 THEN 'D' ELSE 'F' END AS grade FROM e"),
    "coach_intents": (lambda t: coach.intents(t.turns), f"{_FIRST} SELECT {_INTENT} AS intent, count(*) AS sessions FROM p GROUP BY 1"),
    "coach_workflows": (lambda t: coach.workflows(_sessions(t)), f"""{_SESSIONS}, wf AS (SELECT session_id, project, prompt AS text, list_filter(regexp_split_to_array(lower(prompt), '[^a-z]+'), lambda w: w <> '') AS norm FROM cs WHERE length(prompt) >= 15 AND length(prompt) <= 2000 AND lower(prompt) NOT IN ('y', 'n', 'yes', 'no', 'continue', 'try again', 'retry', 'stop', 'abort') AND NOT (contains(lower(prompt), 'continue to iterate') AND length(prompt) < 80)),
        wk AS (SELECT session_id, project, text, array_to_string(norm, ' ') AS norm, list_sort(list_filter(norm, lambda w: length(w) > 1 AND NOT list_contains({_STOPS}, w))) AS w FROM wf), ky AS (SELECT *, array_to_string(w[1:4], '|') AS key FROM wk WHERE len(w) >= 2),
        wn AS (SELECT key, norm, first(text ORDER BY strlen(text), text) AS shortest, count(*) AS n FROM ky GROUP BY 1, 2), wp AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY strlen(shortest), shortest) AS place FROM wn),
        ex AS (SELECT key, array_to_string(list(substr(shortest, 1, 150) ORDER BY place) FILTER (place <= 5), ' / ') AS examples FROM wp GROUP BY 1),
        cl AS (SELECT key, count(*) AS occurrences, count(DISTINCT session_id) AS sessions, string_agg(DISTINCT project, ',' ORDER BY project) AS projects, substr(coalesce(first(text ORDER BY strlen(text), text) FILTER (length(text) >= 20), first(text ORDER BY strlen(text), text)), 1, 100) AS label FROM ky GROUP BY 1 HAVING count(*) >= 3)
        SELECT 'workflow-' || substr(sha256(key), 1, 12) AS id, label, occurrences, sessions, projects, examples FROM cl JOIN ex USING (key) ORDER BY occurrences DESC, label, projects, key LIMIT 10"""),
    "coach_intent_mix": (lambda t: coach.intent_mix(_worked(t)), f"{_WORKED}, it AS (SELECT *, lower(prompt) AS low FROM cw) SELECT CASE WHEN {_ANY('low', coach.INTENTS['Planning'])} THEN 'Planning' WHEN {_ANY('low', coach.INTENTS['Implementation'])} OR churned > 0 OR calls > 0 THEN 'Implementation' WHEN {_ANY('low', coach.INTENTS['Debugging'])} OR failures > 0 THEN 'Debugging' WHEN {_ANY('low', coach.INTENTS['Review'])} THEN 'Review' WHEN {_ANY('low', coach.INTENTS['Exploration'])} THEN 'Exploration' ELSE 'Planning' END AS intent, count(*) AS sessions FROM it GROUP BY 1"),
    "coach_graded_prompts": (lambda t: coach.graded_prompts(_worked(t)), f"{_WORKED}{_GRADED} SELECT * FROM gp"),
    "coach_prompt_issues": (lambda t: coach.prompt_issues(coach.graded_prompts(_worked(t))), f"{_WORKED}{_GRADED}, iu AS (SELECT unnest(string_split(issues, '; ')) AS issue, session_id, total FROM gp WHERE issues <> '') SELECT issue, count(*) AS prompts, {_HALF('avg(total)')} AS mean_total, array_to_string((list(session_id ORDER BY session_id))[1:8], ',') AS samples FROM iu GROUP BY 1"),
    "recall_boosted": (lambda t: coach.rank_boosted(_asked_by_id(t), _entries(t).withColumns({"entities": F.slice(F.array_sort(coach.words(F.col("text"))), 1, 2), "created": F.timestamp_seconds(F.split("key", "-")[0].cast("long") * 3600 + F.split("key", "-")[1].cast("long"))})), f"""{_BOOSTED}, wd AS (SELECT query, key, sum(idf) + 0.1::DOUBLE * any_value(confidence) AS score FROM a JOIN i USING (w) JOIN ps USING (w) GROUP BY 1, 2),
        bo AS (SELECT query, key, sum(boost) AS boost FROM (SELECT query, key, 0.75 * n AS boost FROM ap JOIN ep USING (p) UNION ALL SELECT query, key, 1.5 FROM an JOIN en USING (e)) GROUP BY 1, 2),
        tt AS (SELECT query, key, round(coalesce(score, 0.1::DOUBLE * ec.confidence) + coalesce(boost, 0) + ec.recent, 6)::DOUBLE AS score FROM wd FULL JOIN bo USING (query, key) JOIN ec USING (key)) SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM tt QUALIFY rank <= 5"""),
    "quality_mid_task": (lambda t: coach.mid_task(t.calls, _boundaries(t)), ", b AS (SELECT session_id, call_index AS edge FROM calls WHERE context_tokens % 7 = 0), n AS (SELECT session_id, edge, tool_name, call_index < edge AS early, row_number() OVER (PARTITION BY session_id, edge, call_index < edge ORDER BY abs(call_index - edge)) AS turn FROM b JOIN calls USING (session_id)), s AS (SELECT session_id, edge, len(list_intersect(coalesce(list(DISTINCT tool_name) FILTER (early), []), coalesce(list(DISTINCT tool_name) FILTER (NOT early), []))) >= 2 AS m FROM n WHERE (early AND turn <= 10) OR (NOT early AND turn <= 5) GROUP BY 1, 2) SELECT session_id, count(*) FILTER (m) AS mid_task FROM s GROUP BY 1"),
    "calls_spans": (lambda t: coach.call_spans(t.calls.select("session_id", (F.col("call_index") % 3).alias("call_index"), F.when(F.col("failed"), "errored").when(F.col("call_index") % 2 == 0, "started").otherwise("completed").alias("status"), "ts")), ", e AS (SELECT session_id, call_index % 3 AS call_index, CASE WHEN failed THEN 'errored' WHEN call_index % 2 = 0 THEN 'started' ELSE 'completed' END AS status, epoch_us(ts) AS us FROM calls) SELECT session_id, call_index, min(us) FILTER (status = 'started') AS started, max(us) FILTER (status <> 'started') AS ended FROM e GROUP BY 1, 2"),
    "stats_outcomes": (coach.outcome_block, f"{_CALLS} SELECT count(*) AS sessions, {_HALF('avg(CASE WHEN retries > 0 THEN 1 ELSE 0 END)')} AS retry_rate, {_HALF('avg(compactions)')} AS compactions, {_HALF('avg(churned)')} AS churn FROM graded"),
    "stats_adoption": (coach.adoption, f", b AS (SELECT session_id, count(*) FILTER (category = 'Task') AS n FROM calls GROUP BY 1) SELECT {_HALF('avg(CASE WHEN n > 0 THEN 1 ELSE 0 END)')} AS rate, {_HALF('avg(n)')} AS per_session, (SELECT count(DISTINCT skill) FROM calls WHERE skill <> '') AS skills FROM b"),
    "usage_standalone": (lambda t: coach.standalone(t, _billing(t)), ", b AS (SELECT CASE WHEN event_id % 2 = 0 THEN (event_id // 6)::VARCHAR ELSE '' END AS k, date_trunc('week', ts) AS ts FROM messages WHERE event_id % 3 = 0), r AS (SELECT ts, model, output_tokens FROM messages WHERE role = 'assistant' UNION ALL SELECT min(ts), 'billed', 5 FROM b WHERE k <> '' GROUP BY k UNION ALL SELECT ts, 'billed', 5 FROM b WHERE k = '') SELECT strftime(ts, '%Y-%m-%d') AS date, model, sum(output_tokens)::BIGINT AS output_tokens FROM r GROUP BY 1, 2"),
    "recall_ranked": (lambda t: coach.rank_entries(_asked(t), _entries(t)), f", e AS (SELECT session_id || '-' || ordinal AS key, {_WORDS('content')} AS w, (ordinal % 4) / 4.0::DOUBLE AS confidence FROM turns WHERE role = 'assistant'), ps AS (SELECT DISTINCT key, confidence, unnest(list_distinct(list_concat(w, ['evidence', 'tion_2']))) AS w FROM e), a AS (SELECT session_id || '-' || ordinal AS query, unnest({_WORDS('content')}) AS w FROM turns WHERE role = 'user'), df AS (SELECT w, count(*)::DOUBLE AS df FROM ps WHERE w IN (SELECT w FROM a) GROUP BY 1), i AS (SELECT w, ln(1 + ((SELECT count(*) FROM e) - df + 0.5) / (df + 0.5)) + 1 + CASE WHEN regexp_matches(w, '[_0-9]') THEN 2.0 ELSE 0.0 END AS idf FROM df), s AS (SELECT query, key, round(sum(idf) + 0.1::DOUBLE * any_value(confidence), 6) AS score FROM a JOIN i USING (w) JOIN ps USING (w) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM s QUALIFY rank <= 5"),
    "recall_terms": (lambda t: t.turns.where("role = 'user'").select("session_id", "ordinal", F.array_join(coach.query_terms(F.concat(F.lit('"a phrase" '), "content")), ",").alias("terms")), """, x AS (SELECT session_id, ordinal, '"a phrase" ' || content AS c FROM turns WHERE role = 'user'), y AS (SELECT session_id, ordinal, regexp_extract_all(c, '"([^"]+)"', 1) AS q, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(c, '"[^"]*"', ' ', 'g')), '[^a-z0-9_]+'), lambda w: length(w) >= 3)) AS w FROM x) SELECT session_id, ordinal, array_to_string((list_concat(q, list_transform(list_sort(list_transform(w, lambda v: {'n': -length(v), 'w': v})), lambda s: s.w)))[1:12], ',') AS terms FROM y"""),
    "recall_ranked_all": (lambda t: coach.rank_entries(_asked_by_id(t), _entries(t)), f", e AS (SELECT session_id || '-' || ordinal AS key, {_WORDS('content')} AS w, (ordinal % 4) / 4.0::DOUBLE AS confidence FROM turns WHERE role = 'assistant'), ps AS (SELECT DISTINCT key, confidence, unnest(list_distinct(list_concat(w, ['evidence', 'tion_2']))) AS w FROM e), a AS (SELECT session_id || '-' || ordinal AS query, unnest({_WORDS('content')}) AS w FROM turns WHERE role = 'user' AND session_id % 20 = 0), df AS (SELECT w, count(*)::DOUBLE AS df FROM ps WHERE w IN (SELECT w FROM a) GROUP BY 1), i AS (SELECT w, ln(1 + ((SELECT count(*) FROM e) - df + 0.5) / (df + 0.5)) + 1 + CASE WHEN regexp_matches(w, '[_0-9]') THEN 2.0 ELSE 0.0 END AS idf FROM df), s AS (SELECT query, key, round(sum(idf) + 0.1::DOUBLE * any_value(confidence), 6) AS score FROM a JOIN i USING (w) JOIN ps USING (w) GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM s QUALIFY rank <= 5"),
    "recall_terms_all": (lambda t: t.turns.where("role = 'user'").select("session_id", "ordinal", F.array_join(coach.query_terms(F.concat(F.lit('"a phrase" '), "content")), ",").alias("terms")), """, x AS (SELECT session_id, ordinal, '"a phrase" ' || content AS c FROM turns WHERE role = 'user'), y AS (SELECT session_id, ordinal, regexp_extract_all(c, '"([^"]+)"', 1) AS q, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(c, '"[^"]*"', ' ', 'g')), '[^a-z0-9_]+'), lambda w: length(w) >= 3)) AS w FROM x) SELECT session_id, ordinal, array_to_string((list_concat(q, list_transform(list_sort(list_transform(w, lambda v: {'n': -length(v), 'w': v})), lambda s: s.w)))[1:12], ',') AS terms FROM y"""),
    "recall_log_metrics": (lambda t: coach.log_metrics(t.messages.select(F.col("agent").alias("surface"), (F.col("event_id") % 3).alias("hits"), (F.col("event_id") % 5).alias("packed"))), " SELECT agent AS surface, count(*) AS queries, count(*) FILTER (event_id % 3 > 0) AS hit, count(*) FILTER (event_id % 3 = 0) AS missed, sum(event_id % 5)::BIGINT AS packed FROM messages GROUP BY 1"),
    "recall_evidence": (lambda t: coach.check_evidence(t.turns.select(F.concat_ws("-", "session_id", "ordinal").alias("key"), "session_id", (F.col("ordinal") - 1).alias("first"), (F.col("ordinal") + 1).alias("last")), t.turns.where("ordinal <> 4")), ", v AS (SELECT session_id || '-' || ordinal AS key, session_id, ordinal - 1 AS f, ordinal + 1 AS l FROM turns) SELECT key, count(t.ordinal) = 3 AS sound FROM v LEFT JOIN (SELECT * FROM turns WHERE ordinal <> 4) t ON t.session_id = v.session_id AND t.ordinal BETWEEN f AND l GROUP BY 1"),
    "recall_last_week": (lambda t: coach.temporal(t.messages.select("session_id", "ordinal", F.col("ts").alias("created")), "what did I do last week").select("session_id", "ordinal", "boost"), " SELECT session_id, ordinal, CASE WHEN ts >= m - INTERVAL 7 DAY AND ts < m THEN 1.0 ELSE 0.0 END::DOUBLE AS boost FROM messages, (SELECT max(ts) AS m FROM messages)"),
    "recall_days_ago": (lambda t: coach.temporal(t.messages.select("session_id", "ordinal", F.col("ts").alias("created")), "errors 3 days ago").select("session_id", "ordinal", "boost"), " SELECT session_id, ordinal, CASE WHEN ts::DATE = m::DATE - 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS boost FROM messages, (SELECT max(ts) AS m FROM messages)"),
    "recall_recent": (lambda t: coach.temporal(t.messages.select("session_id", "ordinal", F.col("ts").alias("created")), "the latest decisions").select("session_id", "ordinal", "boost"), " SELECT session_id, ordinal, round(0.25 + 0.75::DOUBLE * (epoch_us(ts) - epoch_us(l)) / (epoch_us(m) - epoch_us(l)), 6)::DOUBLE AS boost FROM messages, (SELECT max(ts) AS m, min(ts) AS l FROM messages)"),
}
