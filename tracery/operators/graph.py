"""Session trees, path prefixes, projects, ordering and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import staged
from ..sources.tables import Tables

def closure(edges: DataFrame) -> DataFrame:
    """root, id, depth: every descendant of every node of edges (id, parent), itself at depth 0.

    Ancestors are doubled: after each round a node knows twice as many levels above it, so a tree of depth d takes
    log d joins. In a cycle each pair of nodes keeps its least depth, so the rounds end there too.
    """
    up = staged(edges.where("parent_id is not null").select("id", F.col("parent_id").alias("above"), F.lit(1).alias("depth")))
    all_, step = up, up
    reach = 1
    while True:
        far = all_.select(F.col("id").alias("above"), F.col("above").alias("top"), F.col("depth").alias("more"))
        grown = step.join(far, "above").select("id", F.col("top").alias("above"), (F.col("depth") + F.col("more")).alias("depth"))
        all_ = staged(all_.unionByName(grown).groupBy("id", "above").agg(F.min("depth").alias("depth")))
        reach *= 2
        step = all_.where(F.col("depth") == reach)
        if not step.take(1):
            break
    return all_.select(F.col("above").alias("root"), "id", "depth").unionByName(edges.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")))


def tops(edges: DataFrame) -> DataFrame:
    """id, root, depth: the highest node above each node of edges (id, parent_id), itself at depth 0 if it has no parent or its parent isn't there.

    Pointers are doubled: a row for each node, and log of the depth rounds. Nodes in a cycle, and below one, have no highest node and are left out.
    """
    there = edges.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    own = staged(edges.join(there, "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("above")))
    done = own.where("above is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"))
    live, reach, n = staged(own.where("above is not null").withColumn("depth", F.lit(1))), 1, own.count()
    while live.take(1) and reach <= 2 * n:
        ends = done.select(F.col("id").alias("above"), "root", F.col("depth").alias("more"))
        ended = staged(live.join(ends, "above").select("id", "root", (F.col("depth") + F.col("more")).alias("depth")))
        open_ = live.join(ended.select("id"), "id", "left_anti")
        hop = live.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"))
        live = staged(open_.join(hop, "above").select("id", F.col("next").alias("above"), (F.col("depth") + F.col("more")).alias("depth")))
        done, reach = staged(done.unionByName(ended)), 2 * reach
    return done


def tree(t: Tables) -> DataFrame:
    return t.sessions.select(F.col("session_id").alias("id"), "parent_id")


def roots(t: Tables) -> DataFrame:
    """Sessions without a parent, and those whose parent isn't there."""
    own = t.sessions
    there = own.select(F.col("session_id").alias("parent_id"))
    return own.join(there, "parent_id", "left_anti").select("session_id")


def delegated(t: Tables) -> DataFrame:
    """root, id: subagents below each root session, at any depth."""
    kinds = t.sessions.select(F.col("session_id").alias("id"), "relationship")
    return tops(tree(t)).where("depth > 0").join(kinds, "id").where("relationship = 'subagent'").select("root", "id")


def rollup(t: Tables) -> DataFrame:
    """Output tokens of each root with its subagents."""
    own = t.sessions.select(F.col("session_id").alias("id"), "total_output_tokens")
    every = delegated(t).unionByName(roots(t).select(F.col("session_id").alias("root"), F.col("session_id").alias("id")))
    return every.join(own, "id").groupBy("root").agg(F.sum("total_output_tokens").alias("output_tokens"), (F.count(F.lit(1)) - 1).alias("subagents"))


def prefixes(path: Column) -> Column:
    """All ancestor directories of a path and the path itself."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def longest_prefix(rows: DataFrame, path: str, rules: DataFrame, *keep: str) -> DataFrame:
    """Adds `rule`: of the rules (prefix, rule) the one with the longest prefix of whole path components."""
    near = rows.select(*keep, F.explode(prefixes(F.col(path))).alias("prefix")).join(rules, "prefix")
    best = near.groupBy(*keep).agg(F.max_by("rule", F.length("prefix")).alias("rule"))
    return rows.select(*keep).join(best, list(keep), "left")


#: Path rules of the test queries.
RULES = [("/work/p1", "one"), ("/work/p1/b0", "one-b0"), ("/work/p2/b1/src", "two-src"), ("/work/p", "none"), ("/work/p3/b1/src/u13", "thirteen")]


def rules(t: Tables) -> DataFrame:
    return t.sessions.sparkSession.createDataFrame(RULES, "prefix string, rule string")


def attributed(t: Tables) -> DataFrame:
    return longest_prefix(t.sessions, "cwd", rules(t), "session_id")


def governed(t: Tables) -> DataFrame:
    """Sessions that each rule decides, none for rules that decide no session."""
    n = attributed(t).groupBy("rule").agg(F.count(F.lit(1)).alias("sessions"))
    return rules(t).join(n, "rule", "left").na.fill(0, ["sessions"]).select("rule", "prefix", "sessions")


def reclassified(t: Tables, prefix: str = "/work/p2", rule: str = "drafted") -> DataFrame:
    """Sessions whose rule a draft rule would change, before and after (E5)."""
    draft = t.sessions.sparkSession.createDataFrame([(prefix, rule)], "prefix string, rule string")
    before = attributed(t).withColumnRenamed("rule", "before")
    after = longest_prefix(t.sessions, "cwd", rules(t).unionByName(draft), "session_id").withColumnRenamed("rule", "after")
    return before.join(after, "session_id").where(~F.col("before").eqNullSafe(F.col("after")))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common directory of two paths."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda n: F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n))
    return F.array_join(F.slice(x, F.lit(1), F.size(F.filter(same, lambda v: v))), "/")


def candidates(t: Tables) -> DataFrame:
    """Projects with their sessions and the directory that all of them share, from the least and the greatest path."""
    return t.sessions.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.min("cwd").alias("a"), F.max("cwd").alias("b")).select("project", "sessions", common_prefix(F.col("a"), F.col("b")).alias("prefix"))


def git_remote(raw: Column) -> Column:
    """host/path of ssh, git, http and scp-like remotes; null for local paths and anything else."""
    raw = F.trim(raw)
    url = F.regexp_extract(raw, r"(?i)^(?:ssh|git|https?)://(?:[^/@]*@)?([^/:?#]+)(?::\d+)?/+([^?#]+?)/*(?:[?#].*)?$", 0) != ""
    host = F.when(url, F.regexp_extract(raw, r"^[^:]+://(?:[^/@]*@)?([^/:?#]+)", 1)).when(raw.rlike(r"^(?:[^/@:]+@)?[^/:\\]{2,}:[^/\\].*$") & ~raw.contains("://"), F.regexp_extract(raw, r"^(?:[^/@:]+@)?([^/:\\]{2,}):", 1))
    path = F.when(url, F.regexp_extract(raw, r"^[^:]+://(?:[^/@]*@)?[^/:?#]+(?::\d+)?/+([^?#]+)", 1)).otherwise(F.regexp_extract(raw, r"^(?:[^/@:]+@)?[^/:\\]{2,}:([^?#]+)", 1))
    clean = F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(\.git)?/*$", "")
    return F.when(host.isNotNull() & (clean != ""), F.concat(F.lower(host), F.lit("/"), clean))


def safe_label(label: Column) -> Column:
    """Empty for labels that look like a path or a URL."""
    return F.when(label.rlike(r"^(/|~|[A-Za-z]:\\)|://|\\\\"), "").otherwise(label)


def identities(t: Tables) -> DataFrame:
    """For each project label whether its machines disagree, and an opaque key."""
    return t.sessions.groupBy("project").agg((F.count_distinct("machine") > 1).alias("ambiguous"), F.sha2(F.concat(F.lit("project:"), "project").cast("binary"), 256).alias("key"))


def recent_edits(t: Tables, k: int = 3) -> DataFrame:
    """The last k edits of each file of a session, with how many there are and whether some are left out."""
    own = Window.partitionBy("session_id", "file_path")
    edits = t.calls.where(F.col("category").isin("Edit", "Write"))
    edits = edits.withColumn("place", F.row_number().over(own.orderBy(F.desc("call_index")))).withColumn("edits", F.count(F.lit(1)).over(own))
    return edits.where(F.col("place") <= k).select("session_id", "file_path", "call_index", "place", "edits", (F.col("edits") > k).alias("truncated"))


def ordered(sessions: DataFrame, spec: list[tuple[str, bool]]) -> DataFrame:
    """Sorts by several keys, each up or down with nulls last, ties by id (O1)."""
    return sessions.orderBy(*(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in spec), "session_id")


def page(sessions: DataFrame, after: tuple, n: int) -> DataFrame:
    """n sessions after (message_count, session_id) in the order of most messages first (O2)."""
    count, key = after
    return ordered(sessions.where((F.col("message_count") < count) | ((F.col("message_count") == count) & (F.col("session_id") > key))), [("message_count", True)]).limit(n)


def tree_page(t: Tables, n: int = 10) -> DataFrame:
    """The n root sessions whose trees were active last, with all members (O3)."""
    members = tops(tree(t))
    members = members.join(t.sessions.select(F.col("session_id").alias("id"), "ended_at"), "id")
    first = members.groupBy("root").agg(F.max("ended_at").alias("latest")).orderBy(F.desc("latest"), "root").limit(n)
    return members.join(first, "root").select("root", "id", "depth")


def label_union(t: Tables) -> DataFrame:
    """Distinct machines of sessions and rules together."""
    return t.sessions.select("machine").unionByName(t.sessions.sparkSession.createDataFrame([("h0",), ("spare",)], "machine string")).distinct()


def quiet_sessions(t: Tables) -> DataFrame:
    """Sessions without any assistant message."""
    return t.sessions.select("session_id").join(t.messages.where("role = 'assistant'").select("session_id"), "session_id", "left_anti")


def alias_at(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds `resolved`: of the alias table (model, valid_from, target) the last row of the model that began by the row's time."""
    own = Window.partitionBy("model").orderBy("valid_from")
    spans = aliases.withColumn("valid_to", F.lead("valid_from").over(own)).withColumnRenamed("model", "alias")
    hit = (rows["model"] == spans["alias"]) & (rows["ts"] >= spans["valid_from"]) & (spans["valid_to"].isNull() | (rows["ts"] < spans["valid_to"]))
    return rows.join(spans, hit, "left").withColumn("resolved", F.coalesce("target", "model")).drop("alias", "valid_from", "valid_to", "target")
