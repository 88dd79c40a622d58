"""Queries of the signal job and what it is made of, over text sessions with calls, with SQL oracles.

The sessions are those of `conversations`; a session's calls are those of the order with its number. Prompts, outputs and statuses
get phrases by their numbers, so that every rule is met by some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import prompts, quality
from ..sources.tables import Tables
from .signals import _HALF

NOW = "2024-01-02 03:00:00"
SAID = ["", " Fix the bug in src/app.py", " You must keep the output format", "\n- first step\n- second step", " add a test for the api", " expected result: done when it runs", " refactor the module", " this is a failing test", " I'm unable to do that", " please verify", " implement the endpoint", " update code"]
SHOWN = ["", "bash: x: command not found", "open y: Permission denied", "exit code 2", "exit status 1\nfatal: no", "  at a\n  at b\n  at c", "Traceback (most recent call last)", "goroutine 12 [running]", "No such file", "1 hunk FAILED", "exit code 0 panic:"]
STATUS = ["", "", "", "completed", "errored", "", "cancelled"]
MODELS = ["gpt-4o-2024-08", "o3", "gpt-4o-mini-x", "other", "gpt-4o"]
COMMANDS = ["python a.py", "rg x", "npm test", "echo a test", ""]


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def messages(t: Tables) -> DataFrame:
    s, o = F.col("session_id"), F.col("ordinal")
    spoken = F.when((F.col("role") == "user") & ((s + o) % 11 == 3), F.lit("Continue")).when((F.col("role") == "user") & ((s + o) % 13 == 5), F.lit("look again")).when((F.col("role") == "assistant") & ((s + o) % 19 == 4), F.lit(" API Error: overloaded")).otherwise(F.concat("content", _pick(SAID, s * 5 + o * 3)))
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (s * 60 + o * (5 + s % 4 * 15)) * 60_000_000)
    return t.turns.select(
        "session_id", "ordinal", "role", "is_system", spoken.alias("content"), at.alias("ts"), F.when(F.col("role") == "assistant", _pick(MODELS, s)).otherwise("").alias("model"),
        (s % 9 == 4).alias("is_automated"), ((F.col("role") == "assistant") & ((s + o) % 17 == 5)).alias("is_boundary"),
    )


def calls(t: Tables) -> DataFrame:
    s, i = F.col("session_id"), F.col("call_index")
    own = t.calls.join(t.turns.select("session_id").distinct(), "session_id", "left_semi").withColumns({"status": _pick(STATUS, s + i), "shown": _pick(SHOWN, s * 3 + i), "command": _pick(COMMANDS, s + i * 2)})
    return own.withColumn("failed", quality.is_failure(F.col("category"), F.col("status"), F.col("shown")))


def repeats(t: Tables) -> DataFrame:
    """Prompts with the same normal form as one before them (of those that count)."""
    own = messages(t).where("role = 'user' and not is_system").withColumn("norm", quality.normal(F.col("content"))).where(F.octet_length("norm") >= 20)
    return own.groupBy("session_id").agg((F.count(F.lit(1)) - F.count_distinct("norm")).alias("repeats"))


#: What some prompts end in.
UPSET = ["", " THIS IS NOT WHAT I SAID AND NOTHING WORKS AT ALL", " come on", " why???", " it doesn't work", " ok!", " still BROKEN here"]


def _upset(t: Tables) -> DataFrame:
    return messages(t).withColumn("content", F.concat("content", _pick(UPSET, F.col("session_id") + F.col("ordinal") * 3)))


def _timed(t: Tables) -> DataFrame:
    """Calls with a start and, but for some, an end."""
    n, i = F.col("context_tokens"), F.col("call_index")
    start = (i * 1000 + n % 700).cast("long")
    return t.calls.select("session_id", F.floor(i / 2).alias("ordinal"), "call_index", "category", start.alias("started"), F.when(n % 13 != 4, start + n % 1500 - 20).alias("ended"))


def job(t: Tables) -> DataFrame:
    return prompts.signals(messages(t), calls(t), repeats(t), NOW)


def _sql(values: list[str]) -> str:
    quoted = ("'" + v.replace("'", "''") + "'" for v in values)
    return "[" + ", ".join(x.replace("\n", "' || chr(10) || '") for x in quoted) + "]"


def _any(col: str, phrases: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(col, p.replace("'", "''")) for p in phrases) + ")"


_TOKEN = lambda words: f"len(list_intersect(tok, {_sql(words)})) > 0"
_MESSAGES = f""", jm AS (SELECT session_id, ordinal, role, is_system, CASE WHEN role = 'user' AND (session_id + ordinal) % 11 = 3 THEN 'Continue' WHEN role = 'user' AND (session_id + ordinal) % 13 = 5 THEN 'look again' WHEN role = 'assistant' AND (session_id + ordinal) % 19 = 4 THEN ' API Error: overloaded' ELSE content || {_sql(SAID)}[(session_id * 5 + ordinal * 3) % {len(SAID)} + 1] END AS content,
  1704067200000000 + (session_id * 60 + ordinal * (5 + session_id % 4 * 15)) * 60000000 AS us, CASE WHEN role = 'assistant' THEN {_sql(MODELS)}[session_id % {len(MODELS)} + 1] ELSE '' END AS model, session_id % 9 = 4 AS is_automated, role = 'assistant' AND (session_id + ordinal) % 17 = 5 AS is_boundary FROM turns)"""
_TRACE = "(contains(shown, 'Traceback (most recent call last)') OR regexp_matches(shown, 'goroutine [0-9]+') OR regexp_matches(shown, '(^|\\n)  at [^\\n]*\\n  at [^\\n]*\\n  at '))"
_FAILED = f"""CASE WHEN status <> '' THEN status IN ('errored', 'cancelled') WHEN category = 'Bash' THEN contains(shown, 'command not found') OR contains(shown, 'Permission denied') OR {_TRACE} OR (regexp_matches(shown, 'exit (status|code) [1-9]') AND {_any('shown', ['command not found', 'No such file', 'Permission denied', 'fatal:', 'panic:'])})
  WHEN category IN ('Edit', 'Write') THEN contains(shown, 'FAILED') ELSE false END"""
_JCALLS = f""", jc0 AS (SELECT *, {_sql(STATUS)}[(session_id + call_index) % {len(STATUS)} + 1] AS status, {_sql(SHOWN)}[(session_id * 3 + call_index) % {len(SHOWN)} + 1] AS shown, {_sql(COMMANDS)}[(session_id + call_index * 2) % {len(COMMANDS)} + 1] AS command FROM calls WHERE session_id IN (SELECT session_id FROM turns)),
jc AS (SELECT * EXCLUDE (failed), {_FAILED} AS failed FROM jc0)"""
_REF = prompts.FILE_REF.replace("'", "''")
_PROMPTS = f""", pr AS (SELECT *, CASE WHEN role = 'user' THEN trim(regexp_replace(lower(regexp_replace(content, '(?s)```.*?```', ' ', 'g')), '\\s+', ' ', 'g')) ELSE '' END AS norm FROM jm WHERE NOT is_system AND role IN ('user', 'assistant')),
pf AS (SELECT *, norm <> '' AND norm NOT IN (SELECT unnest({_sql(prompts.CONTROL)})) AS subst FROM pr),
pw AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN ordinal END IGNORE NULLS) OVER w AS la, last_value(CASE WHEN role = 'assistant' THEN us END IGNORE NULLS) OVER w AS lat, last_value(CASE WHEN subst THEN ordinal END IGNORE NULLS) OVER w AS ls, min(CASE WHEN subst THEN ordinal END) OVER (PARTITION BY session_id) AS fs FROM pf WINDOW w AS (PARTITION BY session_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
px AS (SELECT *, list_filter(regexp_split_to_array(norm, '[^\\pL\\p{{Nd}}_-]+'), lambda w: strlen(w) >= 3) AS tok, regexp_matches(content, '{_REF}') AS ref FROM pw WHERE norm <> ''),
py AS (SELECT *, ({_TOKEN(prompts.ACTIONS)} AND (ref OR {_TOKEN(prompts.OBJECTS)})) OR {_any('norm', prompts.CODE_PHRASES)} AS code, NOT (ref OR {_TOKEN(prompts.CONSTRAINTS)} OR contains(content, chr(10) || '#') OR regexp_matches(content, '(?m)^\\s*(?:[-*+]|\\d+\\.)\\s+\\S+') OR {_any('norm', prompts.STRUCTURE)}) AS loose FROM px),
pz AS (SELECT session_id, count(*) FILTER (subst AND strlen(norm) < 30 AND (ordinal = fs OR ((ls IS NULL OR la > ls) AND us - lat > 1800000000))) AS short_prompts, bool_or(code) AS code, coalesce(bool_or(CASE WHEN ordinal = fs THEN loose END), false) AS loose, bool_or({_any('norm', prompts.SUCCESS)}) AS crit, bool_or({_any('norm', prompts.VERIFY)}) AS ver, bool_or(ref) AS ref FROM py GROUP BY 1),
ps AS (SELECT session_id, short_prompts, code AND loose AS unstructured, (code AND NOT crit)::INT AS no_criteria, (code AND NOT ver)::INT AS no_checks, (code AND NOT ref)::INT AS no_files FROM pz)"""
_RUN = lambda same: f"sum(CASE WHEN {same} THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY call_index)"
_FACTS = f""", f1 AS (SELECT *, lag(failed) OVER o AS lf, lag(tool_name) OVER o AS lt, lag(input) OVER o AS li, lag(context_tokens) OVER o AS lc FROM jc WINDOW o AS (PARTITION BY session_id ORDER BY call_index)),
ff AS (SELECT session_id, sum(CASE WHEN failed THEN n ELSE 0 END)::BIGINT AS failures, max(CASE WHEN failed THEN n ELSE 0 END) AS longest, arg_max(CASE WHEN failed THEN n ELSE 0 END, run) AS final_streak FROM (SELECT session_id, run, failed, count(*) AS n FROM (SELECT session_id, failed, {_RUN('failed = lf')} AS run FROM f1) GROUP BY 1, 2, 3) GROUP BY 1),
fl AS (SELECT *, {_RUN('tool_name = lt AND input = li')} AS run FROM f1),
fr AS (SELECT session_id, sum(CASE WHEN n >= 3 THEN n - 1 ELSE 0 END)::BIGINT AS retries FROM (SELECT session_id, run, count(*) AS n FROM fl GROUP BY 1, 2) GROUP BY 1),
fc AS (SELECT session_id, count(DISTINCT file_path) FILTER (ordinal - third < 10) AS churned FROM (SELECT *, lag(ordinal, 2) OVER (PARTITION BY session_id, file_path ORDER BY call_index) AS third FROM jc WHERE category IN ('Edit', 'Write')) GROUP BY 1),
fp AS (SELECT session_id, count(*) AS calls, count(*) FILTER (context_tokens < 0.7::DOUBLE * lc) AS compactions, max(context_tokens) AS peak FROM f1 GROUP BY 1),
fw AS (SELECT *, count(*) OVER r AS rn, sum(failed::INT) OVER r AS rf, count(*) OVER t AS tn, sum(failed::INT) OVER t AS tf, list(category) OVER t AS own FROM fl WINDOW r AS (PARTITION BY session_id, run ORDER BY call_index), t AS (PARTITION BY session_id ORDER BY call_index ROWS 11 PRECEDING)),
fx AS (SELECT session_id, bool_or((rn >= 5 AND rf >= 3) OR (tn = 12 AND (tf >= 6 OR (tf >= 3 AND list_max(list_transform(list_distinct(own), lambda x: len(list_filter(own, lambda y: y = x)))) >= 10)))) AND count(*) >= 12 AS runaway FROM fw GROUP BY 1),
fk AS (SELECT session_id, coalesce(bool_or(category IN ('Read', 'Grep', 'Glob') OR (category = 'Bash' AND (regexp_extract(command, '^\\s*(\\S+)', 1) IN (SELECT unnest({_sql(prompts.COMMANDS)})) OR (trim(command) <> '' AND (contains(command, ' test') OR contains(command, ' lint')))))), false) AS looked FROM jc GROUP BY 1)"""
_PARTS = """, mb AS (SELECT b.session_id, b.ordinal AS edge, c.ordinal, c.call_index, tool_name, c.ordinal < b.ordinal AS early FROM jm b JOIN jc c ON b.session_id = c.session_id AND c.ordinal <> b.ordinal WHERE is_boundary),
mn AS (SELECT *, row_number() OVER (PARTITION BY session_id, edge, early ORDER BY CASE WHEN early THEN -ordinal ELSE ordinal END, CASE WHEN early THEN -call_index ELSE call_index END) AS turn FROM mb),
mt AS (SELECT session_id, count(*) FILTER (hit) AS mid_task FROM (SELECT session_id, edge, len(list_intersect(coalesce(list(DISTINCT tool_name) FILTER (early), []), coalesce(list(DISTINCT tool_name) FILTER (NOT early), []))) >= 2 AS hit FROM mn WHERE turn <= CASE WHEN early THEN 10 ELSE 5 END GROUP BY 1, 2) GROUP BY 1),
tm AS (SELECT session_id, model FROM (SELECT session_id, model, count(*) AS n, min(ordinal) AS f FROM jm WHERE role = 'assistant' AND model <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, f) = 1),
pp AS (SELECT session_id, peak / CASE WHEN starts_with(model, 'gpt-4o') THEN 128000 WHEN model = 'o3' THEN 200000 END AS pressure FROM tm JOIN fp USING (session_id) WHERE model <> 'other' AND peak > 0),
rp AS (SELECT session_id, count(*) - count(DISTINCT norm) AS repeats FROM pr WHERE role = 'user' AND strlen(norm) >= 20 GROUP BY 1),
ow AS (SELECT session_id, bool_or(is_automated) AS auto, count(*) FILTER (NOT is_system) AS n, count(*) FILTER (is_boundary) AS bd, arg_max(role, ordinal) AS lr, arg_max(content, ordinal) AS lx, arg_max(us, ordinal) AS lu FROM jm GROUP BY 1)"""
_ALL = f"""{_MESSAGES}{_JCALLS}{_PROMPTS}{_FACTS}{_PARTS}, al AS (SELECT session_id, auto, n, lr, ltrim(lower(lx)) AS lx, epoch_us(TIMESTAMP '{NOW}') - lu < 600000000 AS fresh, coalesce(failures, 0) AS failures, coalesce(longest, 0) AS longest, coalesce(final_streak, 0) AS final_streak, coalesce(retries, 0) AS retries, coalesce(churned, 0) AS churned,
  CASE WHEN bd > 0 THEN bd ELSE coalesce(compactions, 0) END AS compactions, coalesce(mid_task, 0) AS mid_task, pressure, coalesce(short_prompts, 0) AS short_prompts, coalesce(unstructured, false) AS unstructured, coalesce(no_criteria, 0) AS no_criteria, coalesce(no_checks, 0) AS no_checks,
  (coalesce(no_files, 0) > 0 AND NOT coalesce(looked, false))::INT AS no_context, coalesce(repeats, 0) AS repeats, coalesce(runaway, false) AS runaway, coalesce(calls, 0) AS calls, peak IS NOT NULL AS has_context
  FROM ow LEFT JOIN ff USING (session_id) LEFT JOIN fr USING (session_id) LEFT JOIN fc USING (session_id) LEFT JOIN fp USING (session_id) LEFT JOIN fx USING (session_id) LEFT JOIN fk USING (session_id) LEFT JOIN mt USING (session_id) LEFT JOIN pp USING (session_id) LEFT JOIN ps USING (session_id) LEFT JOIN rp USING (session_id)),
oc AS (SELECT *, CASE WHEN auto THEN 'unknown/low' WHEN lr = 'assistant' AND starts_with(lx, 'api error:') THEN CASE WHEN fresh THEN 'unknown/low' ELSE 'errored/medium' END WHEN n = 2 AND lr = 'assistant' THEN 'completed/medium' WHEN n < 3 OR fresh THEN 'unknown/low' WHEN lr = 'user' THEN CASE WHEN n >= 10 THEN 'abandoned/high' ELSE 'abandoned/medium' END
  WHEN final_streak >= 3 THEN 'errored/medium' WHEN lr = 'assistant' THEN CASE WHEN {_any('lx', prompts.GIVE_UP)} THEN 'completed/low' ELSE 'completed/medium' END ELSE 'unknown/low' END AS o FROM al),
op AS (SELECT *, split_part(o, '/', 1) AS outcome, split_part(o, '/', 2) AS confidence FROM oc),
pn AS (SELECT *, [CASE outcome WHEN 'errored' THEN 30 ELSE 0 END, CASE outcome WHEN 'abandoned' THEN 15 ELSE 0 END, least(failures * 3, 30), least(retries * 5, 25), least(churned * 4, 20), CASE WHEN longest >= 3 THEN 10 ELSE 0 END, CASE WHEN compactions >= 2 THEN least((compactions - 1) * 5, 15) ELSE 0 END, least(mid_task * 8, 18), CASE WHEN pressure > 0.9 THEN 10 ELSE 0 END,
  unstructured::INT, CASE WHEN unstructured AND no_criteria > 0 THEN 1 ELSE 0 END, CASE WHEN repeats > 0 AND (outcome IN ('errored', 'abandoned') OR failures > 0 OR retries > 0 OR longest >= 3 OR runaway) THEN least(repeats * 2, 4) ELSE 0 END, no_context * 4, runaway::INT * 5] AS pts,
  NOT (o = 'unknown/low') OR calls > 0 OR has_context OR short_prompts > 0 OR unstructured OR no_criteria > 0 OR no_checks > 0 OR repeats > 0 OR no_context > 0 OR runaway AS scored FROM op),
sc AS (SELECT *, CASE WHEN scored THEN greatest(100 - list_sum(pts), 0)::INT END AS score, CASE WHEN scored THEN array_to_string(list_transform(list_filter(range(1, 15), lambda i: pts[i] > 0), lambda i: ['outcome_errored', 'outcome_abandoned', 'tool_failure_signals', 'tool_retries', 'edit_churn', 'consecutive_failures', 'compactions', 'mid_task_compactions', 'context_pressure_high', 'constraintless_first_prompt', 'missing_success_criteria', 'stuck_repeated_prompts', 'code_task_without_context', 'repeated_failing_tool_cycles'][i] || ':' || pts[i]), ',') END AS penalties FROM pn)"""

#: Models and their windows for the oracle; a name that only has another one before a dash has its window, other names have none.
NAMED = [
    ("claude-opus-4-6", 1000000), ("claude-sonnet-4-6-20260101", 200000), ("claude-sonnet-4-5", 200000), ("claude-haiku-4-5", 200000), ("claude-3-5-sonnet-20241022", 200000), ("claude-3-opus", 200000), ("claude-3-haiku-x", 200000),
    ("gpt-4o-mini-2", 128000), ("gpt-4o", 128000), ("gpt-4-turbo", 128000), ("o3", 200000), ("o4-mini", 200000), ("gemini-2.5-pro", 1000000), ("gemini-2.5-flash-lite", 1000000), ("gemini-2.0-flash", 1000000),
    ("gpt-4", None), ("claude-3", None), ("gpt-4omini", None), ("other", None),
]


def _windows(t: Tables) -> DataFrame:
    """The window of the model of each text session, planted by its number, and a peak of its turns' lengths against it."""
    own = t.turns.groupBy("session_id").agg(F.sum(F.length("content")).alias("peak"), F.count(F.lit(1)).alias("turns"))
    model = F.element_at(F.array(*(F.lit(n) for n, _ in NAMED)), (F.col("session_id") % len(NAMED) + 1).cast("int"))
    said = own.select("session_id", F.lit("assistant").alias("role"), F.lit(0).alias("ordinal"), model.alias("model"))
    return prompts.pressures(said, own).select("session_id", F.round("pressure", 9).alias("pressure"))


QUERIES = {
    "quality_model_windows": (_windows, f", nm(i, size) AS (VALUES {', '.join(f'({i}, {size})' for i, (_, size) in enumerate(NAMED) if size)}), tl AS (SELECT session_id, sum(length(content)) AS peak FROM turns GROUP BY 1) SELECT session_id, round(peak / size, 9) AS pressure FROM tl JOIN nm ON i = session_id % {len(NAMED)} WHERE peak > 0"),
    "quality_tool_failures": (lambda t: calls(t).select("session_id", "call_index", "category", "failed"), f"{_JCALLS} SELECT session_id, call_index, category, failed FROM jc"),
    "quality_prompt_signals": (lambda t: prompts.prompt_signals(messages(t)), f"{_MESSAGES}{_PROMPTS} SELECT * FROM ps"),
    "quality_context_activity": (lambda t: prompts.context_activity(calls(t)), f"{_JCALLS}{_FACTS} SELECT * FROM fk"),
    "quality_window_pressure": (lambda t: prompts.pressures(messages(t), quality.call_facts(calls(t))).select("session_id", F.round("pressure", 6).alias("pressure")), f"{_MESSAGES}{_JCALLS}{_PROMPTS}{_FACTS}{_PARTS} SELECT session_id, round(pressure, 6) AS pressure FROM pp"),
    "quality_signal_job": (job, f"{_ALL} SELECT session_id, outcome, confidence, failures, longest, final_streak, retries, churned, compactions, mid_task, round(pressure, 6) AS pressure, short_prompts, unstructured, no_criteria, no_checks, no_context, repeats, runaway, penalties, score, CASE WHEN score IS NULL THEN NULL WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM sc"),
    "quality_frustration_markers": (lambda t: prompts.frustration_markers(_upset(t)), f"""{_MESSAGES}, up AS (SELECT session_id, content || {_sql(UPSET)}[(session_id + ordinal * 3) % {len(UPSET)} + 1] AS c FROM jm WHERE role = 'user' AND NOT is_system),
        uw AS (SELECT session_id, trim(regexp_replace(lower(regexp_replace(c, '(?s)```.*?```', ' ', 'g')), '\\s+', ' ', 'g')) AS norm, list_filter(regexp_split_to_array(regexp_replace(c, '(?s)```.*?```', ' ', 'g'), '[^\\pL]+'), lambda w: w <> '') AS w FROM up), ul AS (SELECT *, list_filter(w, lambda x: length(x) >= 2) AS l FROM uw)
        SELECT session_id, count(*) FILTER (strlen(norm) >= 10 AND (regexp_matches(norm, '{prompts.HOSTILE.replace("'", "''")}') OR (len(w) >= 3 AND len(l) >= 3 AND len(list_filter(l, lambda x: x = upper(x) AND x <> lower(x))) >= 0.4::DOUBLE * len(l)))) AS markers FROM ul GROUP BY 1"""),
    "stats_outcome_shares": (lambda t: prompts.outcome_shares(job(t)), f"""{_ALL}, gr AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' WHEN score IS NOT NULL THEN 'F' END AS grade FROM sc)
        SELECT count(*) AS sessions, count(*) FILTER (outcome = 'completed') AS completed, count(*) FILTER (outcome IN ('errored', 'abandoned')) AS failed, count(*) FILTER (outcome = 'unknown') AS unknown, {', '.join(f"count(*) FILTER (grade = '{g}') AS grade_{g.lower()}" for g in 'ABCDF')}, count(*) FILTER (grade IS NULL) AS ungraded,
        {_HALF('avg((retries > 0)::INT)')} AS retry_rate, {_HALF('avg(compactions)')} AS compactions, {_HALF('avg(churned)')} AS churn FROM gr"""),
    "calls_timing": (lambda t: prompts.call_timing(_timed(t)), """, tc AS (SELECT session_id, call_index // 2 AS ordinal, call_index, category, call_index * 1000 + context_tokens % 700 AS started, CASE WHEN context_tokens % 13 <> 4 THEN call_index * 1000 + context_tokens % 700 + context_tokens % 1500 - 20 END AS ended FROM calls),
        tk AS (SELECT *, CASE WHEN ended >= started THEN ended - started END AS took, max(ended) OVER (PARTITION BY session_id, ordinal ORDER BY started, call_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tc),
        kc AS (SELECT session_id, category, sum(took) AS us FROM tk WHERE took IS NOT NULL GROUP BY 1, 2), kk AS (SELECT session_id, first(category ORDER BY us DESC, category) AS category FROM kc GROUP BY 1)
        SELECT session_id, count(*) AS calls, count(took) AS timed, sum(took)::BIGINT AS micros, first(call_index ORDER BY took DESC, call_index) FILTER (took IS NOT NULL) AS slowest, max(took) AS slowest_micros, any_value(kk.category) AS category, count(DISTINCT ordinal) FILTER (took IS NOT NULL AND before > started) AS parallel_turns FROM tk LEFT JOIN kk USING (session_id) GROUP BY 1"""),
}
