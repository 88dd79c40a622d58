"""Queries of hybrid search over units and of evidence ranges, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranges, text
from ..sources.tables import LENS_SQL, Tables, lens, read

WORDS = ["the", "and", "of"]
def s():
    return F.col("session_id")


def o():
    return F.col("ordinal")


def _hybrid(spark, d: str) -> DataFrame:
    """Sessions by number: each third is a subagent, each fifth is out of scope. A unit's vector is the one whose id is four times its session and its place."""
    t = lens(spark, d)
    sessions = t.turns.select("session_id").distinct().select("session_id", F.when(s() % 3 == 1, "subagent").otherwise("").alias("relationship"), (s() % 5 != 2).alias("in_scope"))
    vectors = read(spark, d, "embeddings")
    own = text.units(t.turns).select("session_id", "first", (s() * 4 + F.col("unit") - 1).alias("vec_id")).where("vec_id >= session_id * 4 and vec_id < session_id * 4 + 4")
    return text.hybrid_units(t.turns, sessions, own.join(vectors, "vec_id"), vectors.where("vec_id = 0"), WORDS)


_UNITS = """, vis AS (SELECT *, lag(role) OVER w AS pr, lag(is_sidechain) OVER w AS ps FROM turns WHERE NOT is_system AND role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY ordinal)),
un AS (SELECT *, sum(CASE WHEN role = 'user' OR pr IS NULL OR pr = 'user' OR ps <> is_sidechain THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal) AS unit FROM vis),
ur AS (SELECT session_id, unit, min(ordinal) AS first, max(ordinal) AS last, session_id || '-' || min(ordinal) AS key, session_id % 3 = 1 OR arg_min(is_sidechain, ordinal) AS sub FROM un GROUP BY 1, 2)"""
_HYBRID = LENS_SQL + f"""{_UNITS}, dw AS (SELECT session_id, ordinal, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM vis), st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM dw),
hits AS (SELECT session_id, ordinal, len(w) AS l, q, len(list_filter(w, lambda x: x = q)) AS tf FROM dw, (SELECT unnest({WORDS}) AS q) WHERE list_contains(w, q)), df AS (SELECT q, count(*)::DOUBLE AS df FROM hits GROUP BY 1),
bm AS (SELECT session_id, ordinal, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM hits JOIN df USING (q), st WHERE session_id % 5 <> 2 GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, session_id, ordinal) AS rank FROM bm QUALIFY rank <= 80),
kw AS (SELECT key, sub, row_number() OVER (ORDER BY min(rank)) AS rank FROM top JOIN ur ON ur.session_id = top.session_id AND ordinal BETWEEN first AND last GROUP BY 1, 2),
nv AS (SELECT key, sub, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS sim FROM ur JOIN embeddings e ON e.vec_id = session_id * 4 + unit - 1 AND unit <= 4 WHERE session_id % 5 <> 2),
nk AS (SELECT key, sub, row_number() OVER (ORDER BY sim DESC, key) AS rank FROM nv QUALIFY rank <= 80)
SELECT key, round(sum(1 / (60 + rank + CASE WHEN sub THEN 5 ELSE 0 END)), 9) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM nk) GROUP BY 1 ORDER BY score DESC, key LIMIT 20"""

FIELDS = ["role", "content"]


def _now(t: Tables) -> DataFrame:
    """The turns as they are later: some changed, some swapped with the next, some lost."""
    moved = F.when((s() % 7 == 3) & (o() == 2), 3).when((s() % 7 == 3) & (o() == 3), 2).otherwise(o())
    said = F.when((s() % 7 == 4) & (o() == 2), F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return t.turns.where(~((s() % 7 == 5) & (o() == 2)) & ~((s() % 7 == 6) & (o() == 1))).select("session_id", moved.alias("ordinal"), "role", said.alias("content"))


def _verdicts(t: Tables) -> DataFrame:
    """Three ranges of each session: turns 1 to 3, 2 to 2, and one that ends before it begins."""
    one = t.turns.select("session_id").distinct()
    spans = one.select("session_id", F.explode(F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ((1, 3), (2, 2), (3, 1))))).alias("r")).select(F.concat_ws("-", "session_id", "r.first", "r.last").alias("entry"), "session_id", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))
    kept = ranges.range_digests(spans, t.turns, FIELDS).withColumnRenamed("digest", "kept").drop("n")
    return ranges.evidence_verdicts(kept, _now(t), FIELDS)


_VERDICTS = """, now AS (SELECT session_id, CASE WHEN session_id % 7 = 3 AND ordinal = 2 THEN 3 WHEN session_id % 7 = 3 AND ordinal = 3 THEN 2 ELSE ordinal END AS ordinal, role, CASE WHEN session_id % 7 = 4 AND ordinal = 2 THEN content || '!' ELSE content END AS content
  FROM turns WHERE NOT (session_id % 7 = 5 AND ordinal = 2) AND NOT (session_id % 7 = 6 AND ordinal = 1)),
en AS (SELECT DISTINCT session_id, a, b FROM turns, (VALUES (1, 3), (2, 2), (3, 1)) v(a, b)),
was AS (SELECT en.session_id, a, b, list((ordinal, role, content) ORDER BY ordinal) AS l FROM en JOIN turns t ON t.session_id = en.session_id AND ordinal BETWEEN a AND b GROUP BY ALL),
got AS (SELECT en.session_id, a, b, list((ordinal, role, content) ORDER BY ordinal) AS l, min(ordinal) AS lo, max(ordinal) AS hi FROM en JOIN now t ON t.session_id = en.session_id AND ordinal BETWEEN a AND b GROUP BY ALL)
SELECT en.session_id || '-' || en.a || '-' || en.b AS entry, CASE WHEN en.b < en.a THEN 'invalid' WHEN g.l IS NULL OR lo <> en.a OR hi <> en.b THEN 'missing' WHEN len(g.l) <> en.b - en.a + 1 THEN 'gap' WHEN g.l IS DISTINCT FROM w.l THEN 'changed' ELSE 'intact' END AS verdict
FROM en LEFT JOIN got g USING (session_id, a, b) LEFT JOIN was w USING (session_id, a, b)"""

def _trees(t: Tables) -> DataFrame:
    """Each text session as a JSON tree: its turns in an array, beside nested arrays, numbers and blanks."""
    turn = F.struct("ordinal", "content", F.array("role").alias("who"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["ordinal"].alias("n"), x["who"].alias("who"), x["content"].alias("content")))
    head = F.struct(F.lit(" lead\n").alias("y"), F.array(F.array(F.lit("deep")), F.array(F.lit("  "))).alias("x"), F.lit(True).alias("b"))
    return t.turns.groupBy(s().alias("key")).agg(F.to_json(F.struct(turns.alias("zeta"), F.lit(1).alias("mid"), head.alias("alpha"))).alias("json"))


_TREES = """, tt AS (SELECT session_id AS key, 'deep' || chr(10) || 'lead' || chr(10) || string_agg(regexp_replace(content, '^\\s+|\\s+$', '', 'g') || chr(10) || role, chr(10) ORDER BY ordinal) AS text FROM turns GROUP BY 1),
tc AS (SELECT key, text, unnest(generate_series(0, (length(text) - 1) // 700))::INT AS chunk FROM tt)
SELECT key, chunk, substr(text, chunk * 700 + 1, 700) AS text, sha256('["trajectory","run","' || key || '","' || chunk || '"]') AS id FROM tc"""

TABLE_QUERIES = {"text_hybrid_units": (_hybrid, _HYBRID)}
QUERIES = {"recall_evidence_verdicts": (_verdicts, _VERDICTS), "text_trajectory_chunks": (lambda t: text.trajectory_chunks(_trees(t), "run", 700), _TREES)}
