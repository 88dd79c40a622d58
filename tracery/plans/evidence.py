"""Queries of project evidence and reporting days, with SQL oracles. Evidence is planted on the sessions of the lens so that its sources conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import concurrency, evidence, reporting
from ..sources.tables import Tables

def u():
    return F.col("user_id")


def sessions(t: Tables) -> DataFrame:
    """Each ninth user's sessions have no working directory; users whose numbers are 60 apart write one file."""
    cwd = F.when(u() % 9 == 4, "").when(u() % 9 == 5, F.concat(F.lit("//work/"), "project", F.lit("/"))).otherwise(F.col("cwd"))
    return t.sessions.select("session_id", "user_id", "project", "machine", cwd.alias("cwd"), F.concat(F.lit("/logs/"), (u() % 60).cast("string"), F.lit("-"), F.substring_index("session_id", "-", -1)).alias("file_path"))


def snapshots(t: Tables) -> DataFrame:
    """Of each third user: some without a key, some of another machine, some with a worktree."""
    own = sessions(t).where("user_id % 3 = 0")
    root = F.concat(F.lit("/work/"), "project")
    return own.select("session_id", "project", F.when(u() % 4 == 1, "elsewhere").otherwise(F.col("machine")).alias("machine"), root.alias("root_path"), F.when(u() % 6 == 0, F.concat(root, F.lit("/b0/"))).alias("worktree_root"), F.when(u() % 12 == 3, "git").alias("key_source"))


def observations(t: Tables) -> DataFrame:
    """Of projects and machines: roots of several depths, remotes of some projects, an ambiguous one."""
    own = t.sessions.select("project", "machine").distinct()
    deep = own.select("project", "machine", F.explode(F.array(F.lit(""), F.lit("/b1"), F.lit("/b1/src"))).alias("tail")).where("project <> 'p4'")
    remote = F.when(F.col("project") == "p1", "git@Host.org:team/one.git").when((F.col("project") == "p2") & (F.col("machine") == "h2"), "https://host.org/team/two").when(F.col("project") == "p2", "ssh://git@host.org/team/other.git")
    return deep.select("project", "machine", F.concat(F.lit("/work/"), "project", "tail").alias("root_path"), F.lit(None).cast("string").alias("worktree_root"), remote.alias("remote"), ((F.col("project") == "p3") & (F.col("tail") == "/b1")).alias("ambiguous"))


MAPPINGS = [("h0", "/work/p0/", "zero", True), ("h0", "/work/p0/b0", "zero-b0", True), ("h1", "/work/p1/b1", "one", True), ("h1", "/work/p1/b1", "one", True), ("h2", "/work/p2", "two", False), ("h2", "/", "rest", True), ("h3", "/work/p3/b1/src", "three", True), ("h3", "/work/p3/b1", "one", True), ("h9", "/nowhere", "none", True)]


def mappings(t: Tables) -> DataFrame:
    return t.sessions.sparkSession.createDataFrame(MAPPINGS, "machine string, prefix string, target string, enabled boolean")


#: The same in SQL.
_CLEAN = lambda c: f"CASE WHEN regexp_replace(trim(coalesce({c}, '')), '/+', '/', 'g') = '/' THEN '/' ELSE regexp_replace(regexp_replace(trim(coalesce({c}, '')), '/+', '/', 'g'), '/$', '') END"
_SIZED = lambda *ps: "sha256(" + " || ".join(f"unhex(printf('%08x', strlen({p}))) || encode({p})" for p in ps) + ")"
_SESSIONS = f""", es0 AS (SELECT session_id, user_id, project, machine, CASE WHEN user_id % 9 = 4 THEN '' WHEN user_id % 9 = 5 THEN '//work/' || project || '/' ELSE cwd END AS cwd,
  '/logs/' || user_id % 60 || '-' || split_part(session_id, '-', -1) AS file_path FROM sessions), es AS (SELECT *, {_CLEAN("cwd")} AS place FROM es0)"""
_UNDER = lambda dir_, path: f"({dir_} = {path} OR ({dir_} = '/' AND starts_with({path}, '/')) OR starts_with({path}, {dir_} || '/'))"
_EVIDENCE = f"""{_SESSIONS},
shots AS (SELECT session_id, CASE WHEN user_id % 6 = 0 THEN '/work/' || project || '/b0' WHEN user_id % 12 = 3 THEN '/work/' || project END AS shot FROM es WHERE user_id % 3 = 0 AND user_id % 4 <> 1),
obs AS (SELECT DISTINCT project, machine, '/work/' || project || tail AS dir, tail FROM sessions, (VALUES (''), ('/b1'), ('/b1/src')) v(tail) WHERE project <> 'p4'),
best AS (SELECT session_id, arg_max(dir, length(dir)) AS dir FROM es JOIN obs USING (project, machine) WHERE place <> '' AND {_UNDER("dir", "place")} GROUP BY 1),
ev AS (SELECT es.*, CASE WHEN shot IS NOT NULL THEN 'snapshot' WHEN dir IS NOT NULL THEN 'aggregate' WHEN place <> '' THEN 'fallback' ELSE 'unavailable' END AS kind, coalesce(shot, dir, '') AS root FROM es LEFT JOIN shots USING (session_id) LEFT JOIN best USING (session_id)),
grp AS (SELECT machine, kind, root, CASE WHEN kind = 'fallback' THEN place ELSE '' END AS own, count(*) AS sessions, count(DISTINCT place) FILTER (place <> '') AS cwds,
  min(string_split(place, '/')) FILTER (place <> '') AS a, max(string_split(place, '/')) FILTER (place <> '') AS b, list(session_id ORDER BY session_id)[1:10] AS e FROM ev GROUP BY ALL),
pre AS (SELECT *, CASE WHEN a IS NULL THEN '' WHEN kind = 'fallback' THEN own ELSE array_to_string(a[1:len(list_filter(generate_series(1, least(len(a), len(b))), lambda n: a[1:n] = b[1:n]))], '/') END AS p FROM grp)
SELECT {_SIZED("machine", "kind", "root", "own")} AS candidate_id, machine, kind, root, CASE WHEN p = '' AND a IS NOT NULL THEN '/' ELSE p END AS prefix, sessions, cwds, p <> '' AS available, array_to_string(e, ',') AS examples FROM pre"""
_RULED = f"""{_SESSIONS}, maps(machine, prefix, target, enabled) AS (VALUES {", ".join(str(m).replace("True", "true").replace("False", "false") for m in MAPPINGS)}),
live AS (SELECT DISTINCT machine, {_CLEAN("prefix")} AS prefix, target FROM maps WHERE enabled),
own AS (SELECT es.*, r.prefix, r.target FROM es LEFT JOIN LATERAL (SELECT prefix, target FROM live WHERE live.machine = es.machine AND place <> '' AND {_UNDER("prefix", "place")} ORDER BY length(prefix) DESC LIMIT 1) r ON true),
lent AS (SELECT machine, file_path, arg_min(prefix, session_id) AS p, min(target) AS g FROM own WHERE place <> '' GROUP BY ALL HAVING count(*) = count(target) AND count(DISTINCT target) = 1),
ruled AS (SELECT own.* REPLACE (CASE WHEN place = '' THEN p ELSE own.prefix END AS prefix, CASE WHEN place = '' THEN g ELSE own.target END AS target) FROM own LEFT JOIN lent USING (machine, file_path))"""
_REMOTE = "CASE WHEN project = 'p1' THEN 'host.org/team/one' WHEN project = 'p2' AND machine = 'h2' THEN 'host.org/team/two' WHEN project = 'p2' THEN 'host.org/team/other' END"
_IDENTITIES = f""", obs AS (SELECT DISTINCT project, machine, '/work/' || project || tail AS dir, tail FROM sessions, (VALUES (''), ('/b1'), ('/b1/src')) v(tail) WHERE project <> 'p4'),
n AS (SELECT project, project = 'p3' AND tail = '/b1' AS ambiguous, {_REMOTE} AS remote, CASE WHEN project IN ('p1', 'p2') THEN 'p1:sha256:' || {_SIZED("'project/git/v1'", _REMOTE)} ELSE 'r1:sha256:' || {_SIZED("'root/v1'", "'salt'", "'archive'", "machine", "dir")} END AS k FROM obs),
g AS (SELECT project, bool_or(ambiguous) AS amb, count(DISTINCT k) FILTER (NOT ambiguous) AS n, min(k) AS k, min(remote) AS remote FROM n GROUP BY 1)
SELECT project, 'pl1:sha256:' || {_SIZED("'project-label/v1'", "'salt'", "'archive'", "project")} AS project_key, CASE WHEN n IS NULL THEN 'unknown' WHEN amb OR n > 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution,
  CASE WHEN NOT amb AND n = 1 THEN CASE WHEN remote IS NULL THEN 'root' ELSE 'git_remote' END END AS kind, CASE WHEN NOT amb AND n = 1 THEN k END AS identity, CASE WHEN NOT amb AND n = 1 THEN remote END AS remote
FROM (SELECT DISTINCT project FROM sessions) LEFT JOIN g USING (project)"""

DATE = "2024-01-10"


def _sources(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sources that disagree: users whose numbers are 2 modulo 5 have no events but usage, 3 modulo 5 neither but a start, 4 modulo 5 neither but the time of creation."""
    early = F.col("ts") - F.expr("interval 20 minutes")
    spans = concurrency.intervals(t._replace(messages=t.messages.where(u() % 5 == 0)))
    usage = t.messages.where((u() % 5).isin(0, 1, 2) & (F.col("role") == "assistant")).withColumn("ts", F.when(u() % 5 == 1, early).otherwise(F.col("ts")))
    events = t.messages.where((u() % 5).isin(0, 1))
    made = t.sessions.withColumns({"created_at": F.when(u() % 5 == 4, F.col("started_at") - F.expr("interval 45 minutes")), "started_at": F.when(u() % 5 == 3, F.col("started_at"))})
    return spans, usage, events, made


_US = f"epoch_us(TIMESTAMP '{DATE}')"
_DAY = f""", ord AS (SELECT *, epoch_us(ts) AS tm, lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ordinal) AS lo FROM messages WHERE user_id % 5 = 0),
spans AS (SELECT session_id, lo, least(tm, lo + 300000000) AS hi FROM ord WHERE tm > lo),
usage AS (SELECT session_id, model, output_tokens, CASE WHEN user_id % 5 = 1 THEN epoch_us(ts) - 1200000000 ELSE epoch_us(ts) END AS tm FROM messages WHERE user_id % 5 < 3 AND role = 'assistant'),
ev AS (SELECT session_id, model, epoch_us(ts) AS tm FROM messages WHERE user_id % 5 < 2),
src AS (SELECT session_id, 0 AS k, greatest(lo, {_US}) AS tm FROM spans WHERE least(hi, {_US} + 86400000000) > greatest(lo, {_US}) UNION ALL SELECT session_id, 1, tm FROM usage UNION ALL SELECT session_id, 2, tm FROM ev
  UNION ALL SELECT session_id, 3, epoch_us(started_at) FROM sessions WHERE user_id % 5 = 3 UNION ALL SELECT session_id, 4, epoch_us(started_at) - 2700000000 FROM sessions WHERE user_id % 5 = 4),
day AS (SELECT * FROM src WHERE tm >= {_US} AND tm < {_US} + 86400000000),
seen AS (SELECT session_id, (SELECT min(b.tm) FROM day b WHERE b.session_id = a.session_id AND b.k = min(a.k)) AS tm, min(k) AS k FROM day a GROUP BY 1),
h AS (SELECT (tm - {_US}) // 3600000000 AS hour, session_id, k, project, is_automated FROM seen JOIN sessions USING (session_id)),
p AS (SELECT min(hour) AS hour FROM h GROUP BY project), m AS (SELECT (min(tm) - {_US}) // 3600000000 AS hour FROM (SELECT model, tm FROM ev UNION ALL SELECT model, tm FROM usage) WHERE model <> '' AND tm >= {_US} AND tm < {_US} + 86400000000 GROUP BY model)"""
_FIRST = f"""{_DAY}, f AS (SELECT hour, count(*) AS new_sessions, count(*) FILTER (is_automated) AS automated, count(*) FILTER (NOT is_automated) AS interactive, count(*) FILTER (k > 0) AS untimed FROM h GROUP BY 1),
fp AS (SELECT hour, count(*) AS new_projects FROM p GROUP BY 1), fm AS (SELECT hour, count(*) AS new_models FROM m GROUP BY 1)"""
_ZEROS = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in "new_sessions automated interactive untimed new_projects new_models".split())
_FIELDS = "messages sessions requests output_tokens agent_micros new_sessions automated interactive untimed new_projects new_models".split()
_REPORT = f"""{_FIRST}, hours AS (SELECT x AS hour, {_US} + x * 3600000000 AS lo FROM range(24) r(x)),
a AS (SELECT (tm - {_US}) // 3600000000 AS hour, count(*) AS messages, count(DISTINCT session_id) AS sessions FROM ev WHERE tm >= {_US} AND tm < {_US} + 86400000000 GROUP BY 1),
b AS (SELECT (tm - {_US}) // 3600000000 AS hour, count(*) AS requests, sum(output_tokens) AS output_tokens FROM usage WHERE tm >= {_US} AND tm < {_US} + 86400000000 GROUP BY 1),
c AS (SELECT hour, sum(least(hi, hours.lo + 3600000000) - greatest(spans.lo, hours.lo)) AS agent_micros FROM hours JOIN spans ON spans.hi > hours.lo AND spans.lo < hours.lo + 3600000000 GROUP BY 1),
r AS (SELECT hour, '{DATE}-' || lpad(hour::VARCHAR, 2, '0') AS period, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in _FIELDS)} FROM hours LEFT JOIN a USING (hour) LEFT JOIN b USING (hour) LEFT JOIN c USING (hour) LEFT JOIN f USING (hour) LEFT JOIN fp USING (hour) LEFT JOIN fm USING (hour)),
d AS (SELECT *, sha256(period || {" || ".join(f"'|{c}=' || {c}" for c in _FIELDS)}) AS digest FROM r)
SELECT * EXCLUDE hour, (SELECT sha256(string_agg(digest, ',' ORDER BY hour)) FROM d) AS day_digest FROM d"""

QUERIES = {
    "evidence_candidates": (lambda t: evidence.candidates(sessions(t), snapshots(t), observations(t)), _EVIDENCE),
    "evidence_governed": (lambda t: evidence.governed(sessions(t), mappings(t)), f"{_RULED} SELECT l.machine, l.prefix, l.target, count(session_id) AS sessions FROM live l LEFT JOIN ruled r ON r.machine = l.machine AND r.prefix = l.prefix AND r.target = l.target GROUP BY ALL"),
    "evidence_rules": (lambda t: evidence.rules_list(sessions(t), mappings(t)), f"{_RULED}, n AS (SELECT target, count(*) AS n FROM ruled WHERE target IS NOT NULL GROUP BY 1) SELECT target, count(*) AS rules, count(*) FILTER (enabled) AS enabled, array_to_string(list_sort(list(DISTINCT machine)), ',') AS machines, coalesce(any_value(n), 0) AS sessions FROM maps LEFT JOIN n USING (target) GROUP BY 1"),
    "evidence_identities": (lambda t: evidence.identities(t.sessions, observations(t), "archive", "salt"), _IDENTITIES),
    "reporting_first_seen": (lambda t: reporting.first_seen(DATE, *_sources(t)), f"{_FIRST} SELECT hour, {_ZEROS} FROM f FULL JOIN fp USING (hour) FULL JOIN fm USING (hour)"),
    "reporting_day": (lambda t: reporting.reporting_day(DATE, *_sources(t)), _REPORT),
}
