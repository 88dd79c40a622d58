"""Conflicts and edges of project evidence and reporting days that the given tables don't hold."""

import hashlib

from pyspark.sql import functions as F

from tracery.operators import evidence, reporting


def frames(spark, sessions, snapshots=(), observations=()):
    s = spark.createDataFrame(sessions, "session_id string, project string, machine string, cwd string, file_path string")
    n = spark.createDataFrame(list(snapshots), "session_id string, project string, machine string, root_path string, worktree_root string, key_source string")
    o = spark.createDataFrame(list(observations), "project string, machine string, root_path string, worktree_root string, remote string, ambiguous boolean")
    return s, n, o


def test_evidence_by_precedence(spark):
    s, n, o = frames(
        spark,
        [("a", "p", "m", "/w/p/x", None), ("b", "p", "m", "/w/p-old/x", None), ("c", "p", "m", "/w/p/x/y", None), ("d", "p", "m", None, None), ("e", "p", "m", " /elsewhere//q/ ", None), ("f", "p", "m", "/", None), ("g", "p", "other", "/w/p", None), ("h", "p", "m", "/w/p/x", None)],
        [("a", "p", "m", "/root", "/tree/", ""), ("b", "p", "m", "/placeholder", None, " "), ("c", "q", "m", "/of/another/project", None, "git"), ("h", "p", "m", "/keyed", "", "git")],
        [("p", "m", "/w/p", "", None, False), ("p", "m", "/w/p/x/y", None, None, False), ("p", "m", "/ignored", "/w", None, False), ("p", "m", None, None, None, False)],
    )
    got = {r.session_id: (r.kind, r.root) for r in evidence.evidence(s, n, o).collect()}
    assert got == {"a": ("snapshot", "/tree"), "b": ("aggregate", "/w"), "c": ("aggregate", "/w/p/x/y"), "d": ("unavailable", ""), "e": ("fallback", ""), "f": ("fallback", ""), "g": ("fallback", ""), "h": ("snapshot", "/keyed")}
    rows = {(r.kind, r.root, r.prefix): r for r in evidence.candidates(s, n, o).collect()}
    assert set(rows) == {("snapshot", "/tree", "/w/p/x"), ("snapshot", "/keyed", "/w/p/x"), ("aggregate", "/w", "/w/p-old/x"), ("aggregate", "/w/p/x/y", "/w/p/x/y"), ("unavailable", "", ""), ("fallback", "", "/elsewhere/q"), ("fallback", "", "/"), ("fallback", "", "/w/p")}
    assert not rows["fallback", "", "/"].available and not rows["unavailable", "", ""].available and rows["fallback", "", "/w/p"].available
    want = b"".join(len(x).to_bytes(4, "big") + x for x in (b"m", b"snapshot", b"/tree", b""))
    assert rows["snapshot", "/tree", "/w/p/x"].candidate_id == hashlib.sha256(want).hexdigest()


def test_shared_directories_end_at_components(spark):
    s, n, o = frames(spark, [(str(i), "p", "m", c, None) for i, c in enumerate(["/a/b", "/a/b-c", "/a/b/d"])], [(str(i), "p", "m", "/r", None, "git") for i in range(3)])
    assert [r.prefix for r in evidence.candidates(s, n, o).collect()] == ["/a"]
    s, n, o = frames(spark, [(f"{i:03}", "p", "m", f"/{i}", None) for i in range(30)], [(f"{i:03}", "p", "m", "/r", None, "git") for i in range(30)])
    (r,) = evidence.candidates(s, n, o).collect()
    assert (r.prefix, r.available, r.sessions, r.cwds, r.examples) == ("/", False, 30, 30, ",".join(f"{i:03}" for i in range(10)))


def test_sessions_without_a_directory_borrow_one(spark):
    rules = spark.createDataFrame([("m", "/a", "A", True), ("m", "/b", "B", True), ("m", "/a/deep", "A", True), ("m", "/off", "O", False), ("n", "/a", "N", True)], "machine string, prefix string, target string, enabled boolean")
    rows = [
        ("1", "p", "m", "/a/x", "f1"), ("2", "p", "m", "/a/deep/y", "f1"), ("3", "p", "m", "", "f1"), ("4", "p", "n", "", "f1"),
        ("5", "p", "m", "/a", "f2"), ("6", "p", "m", "/b", "f2"), ("7", "p", "m", None, "f2"),
        ("8", "p", "m", "/a", "f3"), ("9", "p", "m", "/off/q", "f3"), ("10", "p", "m", "", " f3 "),
        ("11", "p", "m", "", ""), ("12", "p", "m", "/ab", "f4"), ("13", "p", "m", "", "f4"),
    ]
    s, _, _ = frames(spark, rows)
    got = {r.session_id: r.target for r in evidence.ruled(s, rules).collect()}
    assert got == {"1": "A", "2": "A", "3": "A", "4": None, "5": "A", "6": "B", "7": None, "8": "A", "9": None, "10": None, "11": None, "12": None, "13": None}
    n = {(r.machine, r.prefix): r.sessions for r in evidence.governed(s, rules).collect()}
    assert n == {("m", "/a"): 4, ("m", "/b"): 1, ("m", "/a/deep"): 1, ("n", "/a"): 0}
    listed = {r.target: (r.rules, r.enabled, r.machines, r.sessions) for r in evidence.rules_list(s, rules).collect()}
    assert listed["A"] == (2, 2, "m", 5) and listed["O"] == (1, 0, "m", 0) and listed["N"] == (1, 1, "n", 0)


def test_identities_of_labels(spark):
    rows = [("git", "m", "/x", None, "git@h.org:a/b.git", False), ("git", "n", "/y", None, "https://h.org/a/b", None), ("two", "m", "/x", None, None, False), ("two", "n", "/x", None, None, False), ("odd", "m", "/x", None, "git@h.org:c/d", True), ("none", "m", None, "", "junk", False), ("tree", "m", "", "/t/", None, False)]
    o = spark.createDataFrame(rows, "project string, machine string, root_path string, worktree_root string, remote string, ambiguous boolean")
    labels = spark.createDataFrame([("git",), ("git",), ("label",)], "project string")
    got = {r.project: r for r in evidence.identities(labels, o, "a", "s").collect()}
    assert {p: r.resolution for p, r in got.items()} == {"git": "resolved", "two": "ambiguous", "odd": "ambiguous", "none": "unknown", "tree": "resolved", "label": "unknown"}
    assert (got["git"].kind, got["git"].remote) == ("git_remote", "h.org/a/b") and got["tree"].kind == "root" and got["two"].identity is None
    other = {r.project: r for r in evidence.identities(labels, o, "other", "s").collect()}
    assert other["git"].identity == got["git"].identity and other["tree"].identity != got["tree"].identity and other["git"].project_key != got["git"].project_key


def test_first_seen_by_the_best_source(spark):
    ts = lambda rows, more="": spark.createDataFrame(rows, f"session_id string, at string{more}").withColumn("ts", F.col("at").cast("timestamp"))
    us = lambda x: F.unix_micros(F.lit(x).cast("timestamp"))
    spans = spark.createDataFrame([("a", "2024-01-09 23:58:00", "2024-01-10 00:01:00"), ("b", "2024-01-09 23:00:00", "2024-01-10 00:00:00")], "session_id string, l string, h string").select("session_id", F.unix_micros(F.col("l").cast("timestamp")).alias("lo"), F.unix_micros(F.col("h").cast("timestamp")).alias("hi"))
    usage = ts([("a", "2024-01-10 05:00:00", "m1", 7), ("b", "2024-01-10 06:30:00", "m1", 8), ("c", "2024-01-11 00:00:00", "m2", 9)], ", model string, output_tokens long")
    events = ts([("b", "2024-01-10 03:00:00", "m3"), ("c", "2024-01-10 09:00:00", "")], ", model string")
    sessions = spark.createDataFrame([("a", "p", True, None, None), ("b", "p", False, "2024-01-10 01:00:00", None), ("c", "", False, None, None), ("d", "q", None, "2024-01-09 10:00:00", "2024-01-10 23:59:59"), ("e", "r", False, None, None)], "session_id string, project string, is_automated boolean, s string, c string").select("session_id", "project", "is_automated", F.col("s").cast("timestamp").alias("started_at"), F.col("c").cast("timestamp").alias("created_at"))
    first = {r.session_id: (r.source, r["at"]) for r in reporting.session_first("2024-01-10", spans, usage, events, sessions).collect()}
    low = spark.range(1).select(us("2024-01-10")).first()[0]
    assert first == {"a": ("interval", low), "b": ("usage", low + 6 * reporting.HOUR + reporting.HOUR // 2), "c": ("event", low + 9 * reporting.HOUR), "d": ("created", low + 24 * reporting.HOUR - 1_000_000)}
    hours = {r.period: r for r in reporting.reporting_day("2024-01-10", spans, usage, events, sessions).collect()}
    assert len(hours) == 24 and len({r.day_digest for r in hours.values()}) == 1
    h = hours["2024-01-10-00"]
    assert (h.agent_micros, h.new_sessions, h.automated, h.untimed, h.new_projects, h.new_models) == (60_000_000, 1, 1, 0, 1, 0)
    assert hours["2024-01-10-06"].untimed == 1 and hours["2024-01-10-05"].new_models == 1 and hours["2024-01-10-03"].new_models == 1 and hours["2024-01-10-23"].new_projects == 1
    more = ts([("a", "2024-01-10 05:00:00", "m1", 7), ("b", "2024-01-10 06:30:00", "m1", 9), ("c", "2024-01-11 00:00:00", "m2", 9)], ", model string, output_tokens long")
    other = {r.period: r for r in reporting.reporting_day("2024-01-10", spans, more, events, sessions).collect()}
    assert {p for p in hours if hours[p].digest != other[p].digest} == {"2024-01-10-06"} and other["2024-01-10-00"].day_digest != h.day_digest
