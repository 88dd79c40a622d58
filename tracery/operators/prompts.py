"""What prompts say of a session (Q11), its pressure and outcome (Q7, Q9), and the signal job over all signals with the score's penalties (Q14, Q15)."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_away
from .quality import GRADES, call_facts, capped, normal

#: Prompts that only steer, and words and phrases that tell what a prompt has.
CONTROL = ["yes", "y", "no", "n", "ok", "okay", "continue", "go ahead", "proceed", "do it", "done", "thanks", "thank you", "please continue", "keep going"]
ACTIONS = ["implement", "fix", "debug", "refactor", "update", "change", "add", "remove", "create", "write", "test", "lint", "compile", "build", "wire"]
OBJECTS = ["code", "codebase", "repo", "repository", "app", "backend", "frontend", "api", "endpoint", "component", "function", "class", "module", "package", "schema", "migration", "test", "tests", "bug", "error"]
CODE_PHRASES = ["failing test", "stack trace", "build error", "compile error"]
CONSTRAINTS = ["must", "never", "only", "preserve", "keep", "avoid", "require", "requires", "constraint", "constraints", "acceptance", "criteria", "success", "expected", "output", "format", "verify", "validation", "test", "tests"]
STRUCTURE = ["acceptance criteria", "success criteria", "requirements", "steps", "plan", "scope", "non-scope"]
SUCCESS = ["success", "acceptance", "expected", "done when", "should result", "output", "criteria"]
VERIFY = ["test", "tests", "verify", "verification", "validate", "validation", "check", "reproduce", "proof", "run"]
READERS = ["Read", "Grep", "Glob"]
COMMANDS = ["rg", "grep", "git", "ls", "find", "cat", "sed", "awk", "go", "npm", "pnpm", "yarn", "pytest", "cargo", "make"]
GIVE_UP = ["i'm unable to", "i can't proceed", "i don't have access", "i cannot proceed", "i am unable to"]
FILE_REF = r"""(?i)(?:^|[\s"'`])(?:\.{0,2}/)?[a-z0-9_.-]+(?:/[a-z0-9_. -]+)+|[a-z0-9_.-]+\.(?:go|ts|tsx|js|jsx|py|rs|java|kt|rb|php|cs|cpp|c|h|hpp|sql|svelte|vue|css|scss|html|json|ya?ml|toml|md|sh|zsh|bash)"""
BULLET = r"(?m)^\s*(?:[-*+]|\d+\.)\s+\S+"
#: Context windows by model name, or by what stands before a dash in it.
WINDOWS = {
    "claude-opus-4-6": 1_000_000,
    "claude-sonnet-4-6": 200_000,
    "claude-sonnet-4-5": 200_000,
    "claude-haiku-4-5": 200_000,
    "claude-3-5-sonnet": 200_000,
    "claude-3-opus": 200_000,
    "claude-3-haiku": 200_000,
    "gpt-4o-mini": 128_000,
    "gpt-4o": 128_000,
    "gpt-4-turbo": 128_000,
    "o3": 200_000,
    "o4-mini": 200_000,
    "gemini-2.5-pro": 1_000_000,
    "gemini-2.5-flash": 1_000_000,
    "gemini-2.0-flash": 1_000_000,
}


def says(text: Column, phrases: list[str]) -> Column:
    return functools.reduce(operator.or_, (F.contains(text, F.lit(p)) for p in phrases))


def has_token(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def prompt_signals(messages: DataFrame) -> DataFrame:
    """Of each session with messages (session_id, ordinal, role, content, is_system, ts): short prompts where work starts, an unstructured start,
    missing success criteria and verification, and whether a code task's prompts name no file (Q11).

    The first prompt that isn't mere steering starts the work; so does one more than half an hour after the assistant's last message.
    """
    own = Window.partitionBy("session_id").orderBy("ordinal")
    prior = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.where("not is_system and role in ('user', 'assistant')").withColumn("norm", F.when(F.col("role") == "user", F.coalesce(normal(F.col("content")), F.lit(""))).otherwise(""))
    rows = rows.withColumn("substantive", (F.col("norm") != "") & ~F.col("norm").isin(CONTROL))
    rows = rows.withColumns({
        "said": F.last(F.when(F.col("role") == "assistant", F.struct("ordinal", "ts")), ignorenulls=True).over(prior),
        "asked": F.last(F.when(F.col("substantive"), F.col("ordinal")), ignorenulls=True).over(prior),
        "first": F.min(F.when(F.col("substantive"), F.col("ordinal"))).over(Window.partitionBy("session_id")),
    })
    tokens = F.filter(F.split("norm", r"[^\p{L}\p{Nd}_-]+"), lambda w: F.octet_length(w) >= 3)
    p = rows.where("norm <> ''").withColumns({"tokens": tokens, "ref": F.col("content").rlike(FILE_REF)})
    late = F.unix_micros("ts") - F.unix_micros("said.ts") > 1_800_000_000
    fresh = F.col("asked").isNull() | (F.col("said.ordinal") > F.col("asked"))
    starts = (F.col("ordinal") == F.col("first")) | F.coalesce(fresh & late, F.lit(False))
    act = has_token(F.col("tokens"), ACTIONS)
    code = (act & (F.col("ref") | has_token(F.col("tokens"), OBJECTS))) | says(F.col("norm"), CODE_PHRASES)
    loose = ~(F.col("ref") | has_token(F.col("tokens"), CONSTRAINTS) | F.contains("content", F.lit("\n#")) | F.col("content").rlike(BULLET) | says(F.col("norm"), STRUCTURE))
    found = p.groupBy("session_id").agg(
        F.count_if(F.col("substantive") & (F.octet_length("norm") < 30) & starts).alias("short_prompts"), F.bool_or(code).alias("code_task"),
        F.coalesce(F.bool_or(F.when(F.col("ordinal") == F.col("first"), loose)), F.lit(False)).alias("loose_start"),
        F.bool_or(says(F.col("norm"), SUCCESS)).alias("criteria"), F.bool_or(says(F.col("norm"), VERIFY)).alias("checks"), F.bool_or("ref").alias("files"),
    )
    missing = lambda c: (F.col("code_task") & ~F.col(c)).cast("int")
    return found.select("session_id", "short_prompts", (F.col("code_task") & F.col("loose_start")).alias("unstructured"), missing("criteria").alias("no_criteria"), missing("checks").alias("no_checks"), missing("files").alias("no_files"))


def context_activity(calls: DataFrame) -> DataFrame:
    """Sessions with a call that looks at files or runs a known command (calls: category, command)."""
    first = F.regexp_extract("command", r"^\s*(\S+)", 1)
    looks = F.col("category").isin(READERS) | ((F.col("category") == "Bash") & (first.isin(COMMANDS) | (F.trim("command") != "") & says(F.col("command"), [" test", " lint"])))
    return calls.groupBy("session_id").agg(F.coalesce(F.bool_or(looks), F.lit(False)).alias("looked"))


def window_sizes(models: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """model, size: the window of each name (column model) or else of its longest part before a dash that has one (Q7)."""
    card = models.sparkSession.createDataFrame(list((sizes or WINDOWS).items()), "part string, size long")  # a short list
    parts = F.split("model", "-")
    names = models.select("model").distinct().where("model <> ''").withColumn("part", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))))
    return names.join(F.broadcast(card), "part").groupBy("model").agg(F.max_by("size", F.length("part")).alias("size"))


def pressures(messages: DataFrame, peaks: DataFrame) -> DataFrame:
    """Peak context (session_id, peak) over the window of the session's most frequent assistant model, ties to the one seen first (Q7, Q8)."""
    n = messages.where("role = 'assistant' and model <> ''").groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    top = n.groupBy("session_id").agg(F.max_by("model", F.struct("n", -F.col("first"))).alias("model"))
    return top.join(peaks.where("peak > 0"), "session_id").join(window_sizes(top), "model").select("session_id", (F.col("peak") / F.col("size")).alias("pressure"))


def mid_task(messages: DataFrame, calls: DataFrame, before: int = 10, after: int = 5, shared: int = 2) -> DataFrame:
    """Boundaries (messages with is_boundary) where the ten calls before and the five after, by their messages' ordinals, have two tools in common (Q6)."""
    edges = messages.where("is_boundary").select("session_id", F.col("ordinal").alias("edge"))
    near = edges.join(calls.select("session_id", "ordinal", "call_index", "tool_name"), "session_id").where("ordinal <> edge").withColumn("early", F.col("ordinal") < F.col("edge"))
    sign = F.when(F.col("early"), -1).otherwise(1)
    order = Window.partitionBy("session_id", "edge", "early").orderBy(sign * F.col("ordinal"), sign * F.col("call_index"))
    near = near.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= F.when(F.col("early"), before).otherwise(after))
    tools = lambda early: F.collect_set(F.when(F.col("early") == early, F.col("tool_name")))
    both = near.groupBy("session_id", "edge").agg((F.size(F.array_intersect(tools(True), tools(False))) >= shared).alias("hit"))
    return both.groupBy("session_id").agg(F.count_if("hit").alias("mid_task"))


def outcomes(facts: DataFrame, now: str) -> DataFrame:
    """Adds outcome and confidence to sessions (is_automated, messages, last_role, last_text, last_ts, final_streak) (Q9)."""
    c, low = F.col, F.lower("last_text")
    recent = F.coalesce(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_ts") < 600_000_000, F.lit(False))
    errored = (c("last_role") == "assistant") & F.ltrim(low).startswith("api error:")
    out = F.when(c("is_automated"), "unknown/low").when(errored & recent, "unknown/low").when(errored, "errored/medium").when((c("messages") == 2) & (c("last_role") == "assistant"), "completed/medium")
    out = out.when((c("messages") < 3) | recent, "unknown/low").when((c("last_role") == "user") & (c("messages") >= 10), "abandoned/high").when(c("last_role") == "user", "abandoned/medium")
    out = out.when(c("final_streak") >= 3, "errored/medium").when((c("last_role") == "assistant") & says(low, GIVE_UP), "completed/low").when(c("last_role") == "assistant", "completed/medium").otherwise("unknown/low")
    return facts.withColumn("o", F.split(out, "/")).withColumns({"outcome": c("o")[0], "confidence": c("o")[1]}).drop("o")


def penalties() -> dict[str, Column]:
    """Points off by name (Q14)."""
    c = F.col
    stuck = (c("repeats") > 0) & (c("outcome").isin("errored", "abandoned") | (c("failures") > 0) | (c("retries") > 0) | (c("longest") >= 3) | c("runaway"))
    when = lambda test, n: F.when(test, n).otherwise(0)
    return {
        "outcome_errored": when(c("outcome") == "errored", 30), "outcome_abandoned": when(c("outcome") == "abandoned", 15),
        "tool_failure_signals": capped(c("failures") * 3, 30), "tool_retries": capped(c("retries") * 5, 25), "edit_churn": capped(c("churned") * 4, 20), "consecutive_failures": when(c("longest") >= 3, 10),
        "compactions": when(c("compactions") >= 2, capped((c("compactions") - 1) * 5, 15)), "mid_task_compactions": capped(c("mid_task") * 8, 18), "context_pressure_high": when(F.coalesce(c("pressure") > 0.9, F.lit(False)), 10),
        "constraintless_first_prompt": when(c("unstructured"), 1), "missing_success_criteria": when(c("unstructured") & (c("no_criteria") > 0), 1), "stuck_repeated_prompts": when(stuck, capped(c("repeats") * 2, 4)),
        "code_task_without_context": when(c("no_context") > 0, 4), "repeated_failing_tool_cycles": when(c("runaway"), 5),
    }


def health(signals: DataFrame) -> DataFrame:
    """Adds penalties (name:points, those above 0), score (100 less all of them, 0 at least) and grade; an unknown outcome of low confidence without any other basis has none (Q14)."""
    c, points = F.col, penalties()
    told = F.array_join(F.array_compact(F.array(*(F.when(p > 0, F.concat(F.lit(f"{k}:"), p.cast("string"))) for k, p in points.items()))), ",")
    basis = (c("calls") > 0) | c("has_context") | (c("short_prompts") > 0) | c("unstructured") | (c("no_criteria") > 0) | (c("no_checks") > 0) | (c("repeats") > 0) | (c("no_context") > 0) | c("runaway")
    scored = ~((c("outcome") == "unknown") & (c("confidence") == "low")) | basis
    value = F.when(scored, F.greatest(100 - functools.reduce(operator.add, points.values()), F.lit(0)))
    grade = F.when(c("score").isNull(), None)
    for least, name in GRADES:
        grade = grade.when(c("score") >= least, name)
    return signals.withColumns({"penalties": F.when(scored, told), "score": value.cast("int")}).withColumn("grade", grade.otherwise("F"))


def signals(messages: DataFrame, calls: DataFrame, repeats: DataFrame, now: str) -> DataFrame:
    """The signal job (Q15): one row for each session of messages, with Q2 to Q14.

    messages: session_id, ordinal, role, content, is_system, is_automated, is_boundary, ts, model. calls: session_id, call_index, ordinal, category,
    tool_name, input, command, file_path, failed, context_tokens. repeats: session_id, repeats (Q12). All parts are aggregated by session before they are joined.
    """
    last = F.max_by(F.struct("role", "content", "ts"), "ordinal")
    own = messages.groupBy("session_id").agg(F.bool_or("is_automated").alias("is_automated"), F.count_if(~F.col("is_system")).alias("messages"), F.count_if("is_boundary").alias("boundaries"), last.alias("last"))
    own = own.select("session_id", "is_automated", "messages", "boundaries", F.col("last.role").alias("last_role"), F.coalesce("last.content", F.lit("")).alias("last_text"), F.col("last.ts").alias("last_ts"))
    facts = call_facts(calls).withColumn("has_context", F.col("peak").isNotNull())
    out = own
    for part in (facts, prompt_signals(messages), context_activity(calls), mid_task(messages, calls), repeats, pressures(messages, facts)):
        out = out.join(part, "session_id", "left")
    out = out.na.fill(0, ["calls", "failures", "longest", "final_streak", "retries", "churned", "compactions", "mid_task", "repeats", "short_prompts", "no_criteria", "no_checks", "no_files"]).na.fill(False, ["runaway", "has_context", "unstructured", "looked"])
    out = out.withColumns({"compactions": F.when(F.col("boundaries") > 0, F.col("boundaries")).otherwise(F.col("compactions")), "no_context": ((F.col("no_files") > 0) & ~F.col("looked")).cast("int")})
    return health(outcomes(out, now)).select(
        "session_id", "outcome", "confidence", "failures", "longest", "final_streak", "retries", "churned", "compactions", "mid_task", F.round("pressure", 6).alias("pressure"),
        "short_prompts", "unstructured", "no_criteria", "no_checks", "no_context", "repeats", "runaway", "penalties", "score", "grade",
    )


#: Fixed value: what a prompt says where things go badly.
HOSTILE = r"(?i)(!{3,}|\?{3,}|\b(?:wtf|come on|why won't|this is broken|doesn't work|does not work|still broken|same error|you broke|fucking|fuck)\b)"


def frustrated(content: Column, least: int = 3) -> Column:
    """Whether a prompt of ten bytes or more is hostile, or shouts: 0.4 of three or more words of two letters are in capitals (A13). Code fences don't count."""
    words = F.filter(F.split(F.regexp_replace(content, "(?s)```.*?```", " "), r"[^\p{L}]+"), lambda w: w != "")
    long_ = F.filter(words, lambda w: F.length(w) >= 2)
    shouted = F.filter(long_, lambda w: (w == F.upper(w)) & (w != F.lower(w)))
    shouts = (F.size(words) >= least) & (F.size(long_) >= least) & (F.size(shouted) >= 0.4 * F.size(long_))
    norm = normal(content)
    return (F.octet_length(norm) >= 10) & (norm.rlike(HOSTILE) | shouts)


def frustration_markers(messages: DataFrame) -> DataFrame:
    """Frustrated prompts of each session with prompts."""
    return messages.where("role = 'user' and not is_system").groupBy("session_id").agg(F.count_if(frustrated(F.coalesce("content", F.lit("")))).alias("markers"))


def outcome_shares(found: DataFrame) -> DataFrame:
    """One row over the signal job's sessions: outcomes, grades, share of retried sessions, mean compactions and churn."""
    is_ = lambda c, *v: F.count_if(F.col(c).isin(*v))
    mean = lambda x: half_away(F.avg(x), 4)
    return found.agg(
        F.count(F.lit(1)).alias("sessions"), is_("outcome", "completed").alias("completed"), is_("outcome", "errored", "abandoned").alias("failed"), is_("outcome", "unknown").alias("unknown"),
        *(is_("grade", g).alias(f"grade_{g.lower()}") for g in "ABCDF"), F.count_if(F.col("grade").isNull()).alias("ungraded"),
        mean((F.col("retries") > 0).cast("int")).alias("retry_rate"), mean("compactions").alias("compactions"), mean("churned").alias("churn"),
    )


def call_timing(calls: DataFrame) -> DataFrame:
    """Of each session's calls (session_id, ordinal, call_index, category, started, ended in microseconds): time in calls, its slowest call, the category that took
    most, and how many turns had calls side by side (R13). Calls without either end, or that end before they start, have no duration.
    """
    took = F.when(F.col("ended") >= F.col("started"), F.col("ended") - F.col("started"))
    turn = Window.partitionBy("session_id", "ordinal").orderBy("started", "call_index")
    before = F.max("ended").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    rows = calls.withColumn("took", took).withColumn("beside", F.col("took").isNotNull() & (before > F.col("started")))
    own = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.count("took").alias("timed"), F.sum("took").alias("micros"), F.min_by("call_index", F.when(F.col("took").isNotNull(), F.struct((-F.col("took")).alias("t"), "call_index"))).alias("slowest"), F.max("took").alias("slowest_micros"))
    kinds = rows.where("took is not null").groupBy("session_id", "category").agg(F.sum("took").alias("us")).groupBy("session_id").agg(F.min_by("category", F.struct((-F.col("us")).alias("t"), "category")).alias("category"))
    side = rows.where("beside").groupBy("session_id").agg(F.count_distinct("ordinal").alias("parallel_turns"))
    return own.join(kinds, "session_id", "left").join(side, "session_id", "left").na.fill(0, ["parallel_turns"])
