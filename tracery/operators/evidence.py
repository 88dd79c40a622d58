"""What tells a session's project: snapshots of its checkout, what was observed of the project elsewhere, and its working directory.

sessions: session_id, project, machine, cwd, file_path. snapshots: session_id, project, machine, root_path, worktree_root, key_source.
observations: project, machine, root_path, worktree_root, remote, ambiguous. mappings: machine, prefix, target, enabled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import common_prefix, git_remote, prefixes

EXAMPLES = 10


def clean_path(path: Column) -> Column:
    """Without blanks around it, repeated and trailing slashes; empty for null."""
    one = F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), "/+", "/")
    return F.when(one == "/", one).otherwise(F.regexp_replace(one, "/$", ""))


def under(path: Column) -> Column:
    """A clean path and all directories above it, "/" included; none for an empty path."""
    return F.when(path == "", F.array().cast("array<string>")).when(path == "/", F.array(F.lit("/"))).otherwise(F.transform(prefixes(path), lambda p: F.when(p == "", F.lit("/")).otherwise(p)))


def length_prefixed(*parts: Column) -> Column:
    """SHA-256 in hexadecimal of texts, each with its length in bytes before it in four bytes, so that no two lists of parts are one text."""
    sized = [x for p in parts for x in (F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")), p.cast("binary"))]
    return F.sha2(F.concat(*sized), 256)


def evidence(sessions: DataFrame, snapshots: DataFrame, observations: DataFrame) -> DataFrame:
    """Adds kind, root and place (the clean cwd) to sessions: what each is grouped by.

    A snapshot of the same project and machine comes first: its worktree's root, or its root if inspection found a key. Then the longest
    root observed of the project on the machine that holds the working directory. Then that directory itself.
    """
    own = sessions.withColumn("place", clean_path(F.col("cwd")))
    tree, root = clean_path(F.col("worktree_root")), clean_path(F.col("root_path"))
    # At most one snapshot of a session counts: the one of the least root.
    shot = snapshots.select("session_id", "project", "machine", F.when(tree != "", tree).when(F.trim(F.coalesce("key_source", F.lit(""))) != "", root).alias("shot")).where("shot <> ''")
    shot = shot.groupBy("session_id", "project", "machine").agg(F.min("shot").alias("shot"))
    known = observations.select("project", "machine", F.when(tree != "", tree).otherwise(root).alias("dir")).where("dir <> ''").distinct()
    # Directories are matched once for each place of a project, however many sessions worked there.
    places = own.select("project", "machine", "place").where("place <> ''").distinct()
    held = places.withColumn("dir", F.explode(under(F.col("place")))).join(known, ["project", "machine", "dir"]).groupBy("project", "machine", "place").agg(F.max_by("dir", F.length("dir")).alias("observed"))
    both = own.join(shot, ["session_id", "project", "machine"], "left").join(held, ["project", "machine", "place"], "left")
    kind = F.when(F.col("shot").isNotNull(), "snapshot").when(F.col("observed").isNotNull(), "aggregate").when(F.col("place") != "", "fallback").otherwise("unavailable")
    return both.withColumns({"kind": kind, "root": F.coalesce("shot", "observed", F.lit(""))}).drop("shot", "observed")


def candidates(sessions: DataFrame, snapshots: DataFrame, observations: DataFrame) -> DataFrame:
    """Groups of sessions that one path rule could name, by their evidence.

    candidate_id, machine, kind, root, prefix (the directory that all their working directories share), sessions, cwds, available
    (there is a prefix and it isn't the file system's root) and examples (the first sessions by id).
    """
    rows = evidence(sessions, snapshots, observations).withColumn("own", F.when(F.col("kind") == "fallback", F.col("place")).otherwise(""))
    group = ["machine", "kind", "root", "own"]
    path = F.when(F.col("place") != "", F.col("place"))
    parts = F.split(path, "/")
    one = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct(path).alias("cwds"), F.min(parts).alias("a"), F.max(parts).alias("b"))
    shared = common_prefix(F.array_join("a", "/"), F.array_join("b", "/"))
    one = one.withColumn("prefix", F.when(F.col("a").isNull(), "").when(F.col("kind") == "fallback", F.col("own")).when((shared == "") & (F.element_at("a", 1) == ""), "/").otherwise(shared))
    first = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*group).orderBy("session_id"))).where(F.col("turn") <= EXAMPLES)
    first = first.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list(F.col("session_id").cast("string"))), ",").alias("examples"))
    told = one.join(first, group)
    return told.select(length_prefixed(*map(F.col, group)).alias("candidate_id"), "machine", "kind", "root", "prefix", "sessions", "cwds", ((F.col("prefix") != "") & (F.col("prefix") != "/")).alias("available"), "examples")


def ruled(sessions: DataFrame, mappings: DataFrame) -> DataFrame:
    """Adds prefix and target to sessions: the enabled mapping of the machine with the longest prefix of whole path components.

    A session without a working directory borrows that of the sessions on its machine that wrote the same file, if each of those has a mapping and all
    name one target; of several such directories, the one of the least session id.
    """
    rules = mappings.where("enabled").select("machine", clean_path(F.col("prefix")).alias("prefix"), "target").where("prefix <> ''").groupBy("machine", "prefix").agg(F.min("target").alias("target"))
    own = sessions.withColumns({"place": clean_path(F.col("cwd")), "file": F.trim(F.coalesce("file_path", F.lit("")))})
    # As above, each place of a machine is resolved once.
    places = own.select("machine", "place").where("place <> ''").distinct().withColumn("prefix", F.explode(under(F.col("place"))))
    best = places.join(rules, ["machine", "prefix"]).groupBy("machine", "place").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("rule"))
    own = own.join(best, ["machine", "place"], "left")
    told = own.where("file <> '' and place <> ''").groupBy("machine", "file").agg(F.bool_and(F.col("rule").isNotNull()).alias("all"), F.min("rule.target").alias("low"), F.max("rule.target").alias("high"), F.min_by("rule", "session_id").alias("lent"))
    told = told.where("all and low = high").select("machine", "file", "lent")
    out = own.join(told, ["machine", "file"], "left").withColumn("rule", F.when(F.col("place") == "", F.col("lent")).otherwise(F.col("rule")))
    return out.select(*sessions.columns, F.col("rule.prefix").alias("prefix"), F.col("rule.target").alias("target"))


def governed(sessions: DataFrame, mappings: DataFrame) -> DataFrame:
    """machine, prefix, target, sessions: how many sessions each enabled mapping decides, none for those that decide no session."""
    n = ruled(sessions, mappings).where("prefix is not null").groupBy("machine", "prefix", "target").agg(F.count(F.lit(1)).alias("n"))
    rules = mappings.where("enabled").select("machine", clean_path(F.col("prefix")).alias("prefix"), "target").distinct()
    return rules.join(n, ["machine", "prefix", "target"], "left").select("machine", "prefix", "target", F.coalesce("n", F.lit(0)).alias("sessions"))


def rules_list(sessions: DataFrame, mappings: DataFrame) -> DataFrame:
    """target, rules, enabled ones, their machines in order and the sessions that they decide."""
    n = ruled(sessions, mappings).where("target is not null").groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    every = mappings.groupBy("target").agg(F.count(F.lit(1)).alias("rules"), F.count_if("enabled").alias("enabled"), F.array_join(F.array_sort(F.collect_set("machine")), ",").alias("machines"))
    return every.join(n, "target", "left").select("target", "rules", "enabled", "machines", F.coalesce("n", F.lit(0)).alias("sessions"))


def identities(labels: DataFrame, observations: DataFrame, archive: str, salt: str) -> DataFrame:
    """project, project_key, resolution, kind, identity and remote for every label and every observed project.

    An observation names a git remote (host/path), else a root on a machine, under opaque keys: a remote's is the same everywhere, a root's only
    within the archive. resolved: all observations of a label name one thing; ambiguous: several, or one of them is ambiguous; else unknown.
    """
    key = lambda kind, *parts: F.concat(F.lit(f"{kind}:sha256:"), length_prefixed(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    remote, root = git_remote(F.col("remote")), clean_path(F.coalesce(F.nullif("root_path", F.lit("")), "worktree_root"))
    named = F.when(remote.isNotNull(), F.struct(key("p1", "project/git/v1", remote).alias("identity"), F.lit("git_remote").alias("kind"), remote.alias("remote"))).when(
        root != "", F.struct(key("r1", "root/v1", salt, archive, F.col("machine"), root).alias("identity"), F.lit("root").alias("kind"), F.lit(None).cast("string").alias("remote"))
    )
    seen = observations.select("project", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.when(~F.coalesce("ambiguous", F.lit(False)), named).alias("n"))
    one = seen.groupBy("project").agg(F.bool_or("ambiguous").alias("ambiguous"), F.min("n").alias("low"), F.max("n.identity").alias("high"))
    both = labels.select("project").distinct().join(one, "project", "full")
    resolved = ~F.coalesce("ambiguous", F.lit(False)) & (F.col("low.identity") == F.col("high"))
    status = F.when(resolved, "resolved").when(F.coalesce("ambiguous", F.lit(False)) | (F.col("low.identity") != F.col("high")), "ambiguous").otherwise("unknown")
    return both.select("project", key("pl1", "project-label/v1", salt, archive, F.col("project")).alias("project_key"), status.alias("resolution"), *(F.when(resolved, F.col(f"low.{c}")).alias(c) for c in ("kind", "identity", "remote")))
