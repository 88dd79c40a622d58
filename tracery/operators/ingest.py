"""Transcripts to tables: JSON lines of two formats, sanitising, taxonomies, and classifiers over the rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import staged
from .graph import tops
from ..sources.tables import Tables

MAX_TOKENS = 2_000_000
#: A tree of more nodes than this is walked by doubling joins, any other within a task; a task holds about so many nodes of whole trees at once.
TREE_NODES = 1 << 15
#: Raw tool names by category; names not listed are Other.
CATEGORIES = {
    "Read": ["read", "read_file", "view", "cat", "open_file", "readfile", "notebookread"],
    "Edit": ["edit", "multiedit", "apply_patch", "str_replace", "str_replace_editor", "edit_file", "notebookedit", "replace"],
    "Write": ["write", "write_file", "create_file", "save_file"],
    "Bash": ["bash", "shell", "exec_command", "run_terminal_cmd", "run_shell_command", "execute_command", "terminal"],
    "Grep": ["grep", "search", "search_files", "ripgrep", "codebase_search"],
    "Glob": ["glob", "list_files", "find", "list_dir", "ls"],
    "Task": ["task", "agent", "spawn_agent", "subagent"],
    "Tool": ["websearch", "webfetch", "todowrite", "skill", "mcp"],
}
#: How the only user turn of an automated session begins. One that names a product is left out; callers give such ones themselves.
AUTOMATED = [
    "You are a code reviewer.",
    "You are a security code reviewer.",
    "You are a design reviewer.",
    "You are a code assistant. Your task is to address",
    "You are a code review insights analyst.",
    "You are reviewing whether an implementation matches",
    "You are a plan document reviewer.",
    "You are a spec document reviewer.",
    "You are summarizing a day of AI agent activity.",
    "You are analyzing AI agent sessions.",
    "## Analysis Request",
    "# Fix Request",
    "You are a helpful assistant working on a software project.",
    "You are combining multiple code review outputs into a single GitHub PR comment.",
    "You are generating a changelog",
    "<user_action>",
    "Review the code changes introduced by commit ",
    "Review the code changes in commit ",
    "Implement the following plan:",
]
#: What stands anywhere in it.
AUTOMATED_WITHIN = [
    "You are a security code reviewer with an exploitability burden of proof. Review the code changes for concrete vulnerabilities",
    "You are a conversation title generator",
]
#: All of it but for blanks around it.
AUTOMATED_WHOLE = ["Warmup", "Respond with exactly: OK", "Reply with exactly OK."]
#: Shared fields of the lines of the uuid-tree format, and of the event-log format.
TREE = "type string, uuid string, parentUuid string, timestamp string, isMeta boolean, message struct<role:string,model:string,content:string,usage:struct<input_tokens:long,output_tokens:long>>"
LOG = "type string, timestamp string, payload struct<id:string,model:string,role:string,text:string,output_tokens:long>"


def lines(spark, path: str) -> DataFrame:
    """file, line_no, value of JSON lines. Files are read line by line, a long one in several splits; a line's number follows from its split's place in the file and its own place in the split."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("split", "n")) - 1
    return rows.select("file", number.alias("line_no"), "value").where("value <> ''")


def uuid_tree(rows: DataFrame) -> DataFrame:
    """Messages of files whose lines are turns with ids and parents; lines that are no turn are dropped, meta lines are system turns."""
    own = rows.withColumn("j", F.from_json("value", TREE)).where(F.col("j.type").isin("user", "assistant") & F.col("j.message.role").isNotNull())
    order = Window.partitionBy("file").orderBy("line_no")
    return own.select("file", (F.row_number().over(order) - 1).alias("ordinal"), F.col("j.message.role").alias("role"), F.col("j.message.content").alias("content"), F.coalesce("j.message.model", F.lit("")).alias("model"), F.coalesce("j.isMeta", F.lit(False)).alias("is_system"), F.col("j.uuid").alias("uuid"), F.col("j.parentUuid").alias("parent_uuid"), F.try_to_timestamp("j.timestamp").alias("ts"), F.coalesce("j.message.usage.output_tokens", F.lit(0)).alias("output_tokens"))


def event_log(rows: DataFrame) -> DataFrame:
    """Messages of files of typed records: each assistant turn has the model of the last turn_context before it and the tokens of the next token_count."""
    own = Window.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("j", F.from_json("value", LOG)).where("j.type is not null")
    model = F.last(F.when(F.col("j.type") == "turn_context", F.col("j.payload.model")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    tokens = F.when(F.lead("j.type").over(own) == "token_count", F.lead("j.payload.output_tokens").over(own))
    rows = rows.withColumns({"model": model, "tokens": tokens}).where("j.type = 'response_item'")
    return rows.select("file", (F.row_number().over(own) - 1).alias("ordinal"), F.col("j.payload.role").alias("role"), F.col("j.payload.text").alias("content"), F.when(F.col("j.payload.role") == "assistant", F.coalesce("model", F.lit(""))).otherwise("").alias("model"), F.coalesce("tokens", F.lit(0)).alias("output_tokens"))


def unchanged(export: DataFrame, stored: DataFrame) -> DataFrame:
    """Conversations (key, text) of an export that are not stored with the same content."""
    return export.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)).join(stored, ["key", "hash"], "left_anti")


def conversation_path(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """conversation, ordinal, role, text of the messages on the way from a conversation's root to its current leaf.

    nodes: conversation, id, parent_id, role, text (null or empty for nodes without a message); leaves: conversation, id. Answers that were made
    anew are siblings of which the way holds one. What is above the leaf is found by doubling pointers: log of the depth rounds.
    """
    own = nodes.select(F.concat_ws("/", "conversation", "id").alias("id"), F.when(F.col("parent_id").isNotNull(), F.concat_ws("/", "conversation", "parent_id")).alias("parent_id"))
    depth = tops(own).select("id", "depth")
    there = own.select(F.col("id").alias("parent_id"), F.col("id").alias("ptr"))
    jump = staged(own.join(there, "parent_id").select("id", "ptr"))
    way = staged(leaves.select(F.concat_ws("/", "conversation", "id").alias("id")))
    while jump.take(1):
        way = staged(way.unionByName(way.join(jump, "id").select(F.col("ptr").alias("id"))).distinct())
        far = jump.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"))
        jump = staged(jump.join(far, "ptr").select("id", F.col("next").alias("ptr")).where("id <> ptr"))
    rows = nodes.withColumn("key", F.concat_ws("/", "conversation", "id")).join(way.withColumnRenamed("id", "key"), "key", "left_semi").join(depth.withColumnRenamed("id", "key"), "key")
    order = Window.partitionBy("conversation").orderBy("depth")
    return rows.where("text <> '' and role in ('user', 'assistant', 'system')").select("conversation", (F.row_number().over(order) - 1).alias("ordinal"), "role", "text")


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, size, modified) that are new or differ from the last run's listing (I4)."""
    return listing.join(state, ["path", "size", "modified"], "left_anti")


def sanitized(messages: DataFrame) -> DataFrame:
    """Tokens clamped, impossible times blanked, unknown roles dropped, control characters out, and which of it was done."""
    tokens = F.least(F.greatest("output_tokens", F.lit(0)), F.lit(MAX_TOKENS))
    bad_time = ~F.col("ts").between(F.lit("2000-01-01").cast("timestamp"), F.lit("2100-01-01").cast("timestamp"))
    text = F.regexp_replace("content", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    kept = messages.where(F.col("role").isin("user", "assistant", "system"))
    return kept.withColumns({"clamped": tokens != F.col("output_tokens"), "blanked": F.coalesce(bad_time, F.lit(False)), "cleaned": text != F.col("content"), "output_tokens": tokens, "ts": F.when(~bad_time, F.col("ts")), "content": text})


def category(tool: Column) -> Column:
    """Read, Edit, Write, Bash, Grep, Glob, Task, Tool or Other."""
    table = F.create_map(*(F.lit(x) for c, names in CATEGORIES.items() for n in names for x in (n, c)))
    return F.coalesce(F.try_element_at(table, F.lower(tool)), F.lit("Other"))


def skill(path: Column) -> Column:
    """The directory of a SKILL.md that is read (I8)."""
    return F.nullif(F.regexp_extract(path, r"([^/\s]+)/SKILL\.md", 1), F.lit(""))


def project(cwd: Column, branch: Column) -> Column:
    """The last component of the working directory, without the branch that a worktree's name ends in."""
    name = F.element_at(F.split(F.rtrim(cwd, F.lit("/")), "/"), -1)
    tail = F.concat(F.lit("-"), F.replace(branch, F.lit("/"), F.lit("-")))
    return F.when((branch != "") & name.endswith(tail) & (F.length(name) > F.length(tail)), F.substring(name, F.lit(1), F.length(name) - F.length(tail))).otherwise(name)


def terminations(messages: DataFrame) -> DataFrame:
    """How each session ends: truncated, tool_call_pending, awaiting_user or clean (I10). Needs role, ordinal, has_tool_use and truncated."""
    last = messages.groupBy("session_id").agg(F.max_by(F.struct("role", "has_tool_use", "truncated"), "ordinal").alias("m"))
    kind = F.when(F.col("m.truncated"), "truncated").when((F.col("m.role") == "assistant") & F.col("m.has_tool_use"), "tool_call_pending").when(F.col("m.role") == "assistant", "awaiting_user").otherwise("clean")
    return last.select("session_id", kind.alias("termination"))


def termination_status(messages: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """session_id, termination of every session (I10): truncated if its file was cut off, tool_call_pending if a call of its last assistant message has no result after it,
    awaiting_user if that message is its end and says so, else clean.

    messages: session_id, ordinal, role, is_system, stop_reason, truncated; calls: session_id, ordinal, call_id; results: session_id, ordinal, call_id.
    """
    own = messages.groupBy("session_id").agg(F.bool_or("truncated").alias("truncated"), F.max_by(F.struct("role", "stop_reason"), F.when(~F.col("is_system"), F.col("ordinal"))).alias("last"), F.max(F.when(~F.col("is_system") & (F.col("role") == "assistant"), F.col("ordinal"))).alias("said"))
    made = calls.join(own.select("session_id", F.col("said").alias("ordinal")), ["session_id", "ordinal"])
    later = results.where("call_id <> ''").join(own.select("session_id", "said"), "session_id").where(F.col("ordinal") > F.col("said")).select("session_id", "call_id").distinct()
    pending = made.join(later, ["session_id", "call_id"], "left_anti").select("session_id", F.lit(True).alias("pending")).distinct()
    waits = (F.col("last.role") == "assistant") & F.coalesce(F.col("last.stop_reason").isin("end_turn", "task_complete"), F.lit(False))
    kind = F.when(F.col("truncated"), "truncated").when(F.col("pending"), "tool_call_pending").when(waits, "awaiting_user").otherwise("clean")
    return own.join(pending, "session_id", "left").select("session_id", kind.alias("termination"))


def doubled(state: DataFrame, step) -> DataFrame:
    """state (id, ptr, ...) after pointer jumping: step(state) doubles how far `ptr` reaches, null once it is past the root.

    A tree of depth d takes log d rounds of as many rows as there are nodes. In a cycle no pointer ever ends, so the rounds stop
    when they have covered all nodes.
    """
    state = staged(state)
    nodes, reach = state.count(), 1
    while reach <= nodes and state.where("ptr is not null").take(1):
        state, reach = staged(step(state)), reach * 2
    return state


def subtree_turns(state: DataFrame) -> DataFrame:
    """A round of `turns`: those of the nodes less than twice as far below."""
    below = state.where("ptr is not null").groupBy(F.col("ptr").alias("id")).agg(F.sum("turns").alias("more"))
    far = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"))
    up = state.where("ptr is not null").join(far, "ptr").select("id", F.col("next").alias("ptr"), "turns").unionByName(state.where("ptr is null"))
    return up.join(below, "id", "left").select("id", "ptr", (F.col("turns") + F.coalesce("more", F.lit(0))).alias("turns"))


def nearest_mark(state: DataFrame) -> DataFrame:
    """A round of `near`, the nearest mark from a node up, and of `dropped`, whether any of its marks so far is."""
    far = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("near").alias("above"), F.col("dropped").alias("lost"))
    up = state.where("ptr is not null").join(far, "ptr").select("id", F.col("next").alias("ptr"), F.coalesce("near", "above").alias("near"), (F.col("dropped") | F.col("lost")).alias("dropped"))
    return up.unionByName(state.where("ptr is null"))


def doubled_owners(nodes: DataFrame, retry_turns: int) -> DataFrame:
    """`forks` by joins: log of the depth rounds of all nodes, for trees of any size."""
    there = nodes.select(F.col("id").alias("parent_id"), F.col("id").alias("ptr"))
    nodes = staged(nodes.where("parent_id is not null").join(there, "parent_id", "left").select("id", "ptr", "role", "place").unionByName(nodes.where("parent_id is null").select("id", F.col("parent_id").alias("ptr"), "role", "place")))
    turns = doubled(nodes.select("id", "ptr", F.col("role").eqNullSafe("user").cast("long").alias("turns")), subtree_turns).select("id", "turns")
    kids = nodes.where("ptr is not null")
    child = F.struct("place", "id")
    ends = kids.groupBy("ptr").agg(F.count(F.lit(1)).alias("n"), F.min(child)["id"].alias("first"), F.max(child)["id"].alias("last")).where("n > 1")
    ends = ends.join(turns.select(F.col("id").alias("first"), (F.col("turns") <= retry_turns).alias("retry")), "first")
    mark = F.when(F.col("retry") & (F.col("id") != F.col("last")), "dropped").when(~F.col("retry") & (F.col("id") != F.col("first")), "fork")
    marks = kids.select("id", "ptr").join(ends, "ptr", "left").select("id", "ptr", mark.alias("mark"))
    marks = marks.unionByName(nodes.where("ptr is null").select("id", "ptr", F.lit("root").alias("mark")))
    own = marks.select("id", "ptr", F.when(F.col("mark").isNotNull(), F.col("id")).alias("near"), F.col("mark").eqNullSafe(F.lit("dropped")).alias("dropped"))
    return doubled(own, nearest_mark).select("id", F.when(~F.col("dropped"), F.col("near")).alias("owner"))


def owners_of(parent: np.ndarray, user: np.ndarray, retry_turns: int) -> np.ndarray:
    """The owner's place, or -1, of nodes of whole trees, children in their order; parent: its place, or -1."""
    n, at, kid = len(parent), np.arange(len(parent)), parent >= 0
    turns, ptr, reach = user.astype(np.int64), parent, 1
    hop = lambda p: np.where(p >= 0, parts[p], -1)
    while reach <= n and (ptr >= 0).any():
        turns = turns + np.bincount(ptr[ptr >= 0], weights=turns[ptr >= 0], minlength=n).astype(np.int64)
        parts = ptr
        ptr, reach = hop(ptr), reach * 2
    first, last = np.full(n, n), np.full(n, -1)
    np.minimum.at(first, parent[kid], at[kid])
    np.maximum.at(last, parent[kid], at[kid])
    above = np.where(kid, parent, 0)
    branches = kid & (first[above] < last[above])
    retry = turns[np.minimum(first[above], n - 1)] <= retry_turns
    dropped = branches & retry & (at != last[above])
    near = np.where(~kid | dropped | branches & ~retry & (at != first[above]), at, -1)
    ptr, reach = parent, 1
    while reach <= n and (ptr >= 0).any():
        up = ptr >= 0
        near, dropped = np.where(up & (near < 0), near[ptr], near), dropped | up & dropped[ptr]
        parts = ptr
        ptr, reach = hop(ptr), reach * 2
    return np.where(dropped, -1, near)


def forks(nodes: DataFrame, retry_turns: int = 3, tree: str | None = None) -> DataFrame:
    """id, owner for nodes (id, parent_id, role, place): where a tree branches and the first child's subtree has more user turns than a
    retry, each later child starts a fork of its own; else the last child is followed and the others are dropped (I11).

    owner: the nearest start of a fork above a node, or its root; null for what a dropped branch holds. A node whose parent isn't
    there is a root. tree: a column that a node has in common with its parent; nodes are then shuffled once by it, and only trees of more
    than TREE_NODES, and nodes where it is null, take the joins of `doubled_owners`, as all do without it.
    """
    if tree is None:
        return doubled_owners(nodes, retry_turns)
    nodes = nodes.withColumnRenamed(tree, "tree")
    own = Window.partitionBy("tree").orderBy("place", "id")
    large = nodes.groupBy("tree").count().where(F.col("tree").isNull() | (F.col("count") > TREE_NODES)).select("tree")
    small, rest = nodes, None
    if large.take(1):
        large = staged(large)
        small = nodes.where("tree is not null").join(large, "tree", "left_anti")
        rest = doubled_owners(nodes.join(large.withColumnRenamed("tree", "big"), F.col("tree").eqNullSafe(F.col("big")), "left_semi").drop("tree"), retry_turns)
    # The number of a node in its tree keeps trees whole and in order, also where the rows are dealt by them already.
    small = small.select("id", "parent_id", F.col("role").eqNullSafe("user").alias("user"), F.row_number().over(own).alias("at"))
    kind = nodes.schema["id"].dataType.simpleString()

    def solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = rows.column("id").combine_chunks()
            parent = pc.fill_null(pc.index_in(rows.column("parent_id").combine_chunks(), ids, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
            found = owners_of(parent.astype(np.int64), rows.column("user").to_numpy(), retry_turns)
            owner = ids.take(pa.array(np.maximum(found, 0), mask=found < 0))
            yield from pa.table({"id": ids, "owner": owner}).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TREE_NODES:
                rows = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(rows.column("at").to_numpy() == 1)[-1])  # where the last tree begins, which may go on
                if cut:
                    yield from done(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    found = small.mapInArrow(solved, f"id {kind}, owner {kind}")
    return found if rest is None else found.unionByName(rest)


def linked(t: Tables) -> DataFrame:
    """Subagent sessions with the session that started them."""
    own = t.sessions.where("relationship = 'subagent'").select("session_id", "parent_id")
    return own.join(t.sessions.select(F.col("session_id").alias("parent_id"), F.col("message_count").alias("parent_messages")), "parent_id")


def automated(turns: DataFrame, prefixes: list[str] | None = None, within: list[str] | None = None, whole: list[str] | None = None) -> DataFrame:
    """Sessions of at most one user turn whose first one with text begins as an automated prompt does, holds a part of one, or is one.

    Patterns that callers give come in the place of the fixed ones, those of other kinds too. Sessions without a user turn have no row.
    """
    given = prefixes is not None or within is not None or whole is not None
    prefixes, within, whole = (prefixes or [], within or [], whole or []) if given else (AUTOMATED, AUTOMATED_WITHIN, AUTOMATED_WHOLE)
    said = F.when(F.trim(F.coalesce("content", F.lit(""))) != "", F.struct("ordinal", "content"))
    own = turns.where("role = 'user' and not is_system").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min(said)["content"].alias("first"))
    hit = F.regexp_replace("first", r"^\s+|\s+$", "").isin(whole)
    for p in prefixes:
        hit = hit | F.col("first").startswith(p)
    for p in within:
        hit = hit | F.contains("first", F.lit(p))
    return own.select("session_id", ((F.col("n") <= 1) & F.coalesce(hit, F.lit(False))).alias("is_automated"))


def audit(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Sessions whose stored flag a new classification would change."""
    both = now.join(stored.withColumnRenamed("is_automated", "was"), "session_id")
    return both.where(~F.col("is_automated").eqNullSafe(F.col("was")))
