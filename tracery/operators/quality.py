"""Quality signals of sessions: tool health, context, outcome, prompts, and the health score over them.

All order-sensitive signals are windows over one session's calls in order, so they share one shuffle by session.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.storage import staged
from ..sources.tables import Tables

#: Points off and their caps; grades from a score on; context windows by model.
GRADES = [(90, "A"), (75, "B"), (60, "C"), (40, "D")]
WINDOWS = {"m0": 200_000, "m1": 1000, "m2": 800}


def in_order() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("call_index")



def is_failure(category: Column, status: Column, content: Column) -> Column:
    """A call that failed (Q1): a status that is told decides alone; else what the output of a shell command or an edit says."""
    has = lambda *words: functools.reduce(operator.or_, (F.contains(content, F.lit(w)) for w in words))
    trace = has("Traceback (most recent call last)") | content.rlike("goroutine [0-9]+") | content.rlike(r"(?:^|\n)  at [^\n]*\n  at [^\n]*\n  at ")
    code = content.rlike("exit (?:status|code) [1-9]") & has("No such file", "fatal:", "panic:")
    said = F.when(category == "Bash", has("command not found", "Permission denied") | trace | code).when(category.isin("Edit", "Write"), has("FAILED")).otherwise(F.lit(False))
    told = F.coalesce(status, F.lit("")) != ""
    return F.when(told, status.isin("errored", "cancelled")).otherwise(F.coalesce(said, F.lit(False)))


def islands(calls: DataFrame, *same: str) -> DataFrame:
    """Numbers the runs of calls that agree in these columns with the call before."""
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(in_order()))
    first = F.lag("call_index").over(in_order()).isNull()
    return calls.withColumn("new", F.when(first | changed, 1).otherwise(0)).withColumn("run", F.sum("new").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def failures(calls: DataFrame) -> DataFrame:
    """Failures of each session: all, the longest run, the run at the end (Q2)."""
    runs = islands(calls, "failed").groupBy("session_id", "run", "failed").agg(F.count(F.lit(1)).alias("n"))
    last = F.max_by(F.when(F.col("failed"), F.col("n")).otherwise(0), "run")
    return runs.groupBy("session_id").agg(F.sum(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("failures"), F.max(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("longest"), last.alias("final_streak"))


def retries(calls: DataFrame) -> DataFrame:
    """Runs of three or more calls with the same tool and input count as their length less one (Q3)."""
    runs = islands(calls, "tool_name", "input").groupBy("session_id", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("session_id").agg(F.sum(F.when(F.col("n") >= 3, F.col("n") - 1).otherwise(0)).alias("retries"))


def edit_churn(calls: DataFrame) -> DataFrame:
    """Files with three edits in a row that span under 10 ordinals (Q4)."""
    own = Window.partitionBy("session_id", "file_path").orderBy("call_index")
    edits = calls.where(F.col("category").isin("Edit", "Write")).withColumn("third", F.lag("ordinal", 2).over(own))
    return edits.groupBy("session_id").agg(F.count_distinct(F.when(F.col("ordinal") - F.col("third") < 10, F.col("file_path"))).alias("churned"))


def compactions(calls: DataFrame) -> DataFrame:
    """Drops of the context by more than 30 % between one reading and the next (Q5)."""
    drop = F.col("context_tokens") < 0.7 * F.lag("context_tokens").over(in_order())
    return calls.where("context_tokens is not null").withColumn("drop", drop).groupBy("session_id").agg(F.count_if("drop").alias("compactions"), F.max("context_tokens").alias("peak"))


def pressure(t: Tables) -> DataFrame:
    """Peak context over the window of the session's dominant model, null where the model has none (Q7, Q8)."""
    card = t.sessions.sparkSession.createDataFrame(list(WINDOWS.items()), "model string, size long")
    return dominant_models(t).join(F.broadcast(card), "model", "left").join(t.sessions.select("session_id", "peak_context_tokens"), "session_id").select("session_id", F.round(F.col("peak_context_tokens") / F.col("size"), 6).alias("pressure"))


def dominant_models(t: Tables) -> DataFrame:
    """Each session's most frequent assistant model, ties to the one seen first (Q8)."""
    n = t.messages.where("role = 'assistant' and model <> ''").groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    return n.groupBy("session_id").agg(F.max_by("model", F.struct("n", -F.col("first"))).alias("model"))


def outcomes(t: Tables, now: str) -> DataFrame:
    """Outcome and confidence of each session from its end and its size; `now` tells which are too recent to judge (Q9)."""
    last = t.messages.groupBy("session_id").agg(F.max_by("role", "ordinal").alias("last_role"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.first("is_automated").alias("auto"), F.max_by("event_type", "ordinal").alias("last_type"))
    recent = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last") < 600_000_000
    errored = (F.col("last_role") == "assistant") & (F.col("last_type") == "error")
    unknown = F.lit("unknown/low")
    out = F.when(F.col("auto"), unknown).when(errored & recent, unknown).when(errored, "errored/medium").when((F.col("n") == 2) & (F.col("last_role") == "assistant"), "completed/medium").when((F.col("n") < 3) | recent, unknown)
    out = out.when((F.col("last_role") == "user") & (F.col("n") >= 10), "abandoned/high").when(F.col("last_role") == "user", "abandoned/medium").when(F.col("last_role") == "assistant", "completed/medium").otherwise(unknown)
    return last.withColumn("o", F.split(out, "/")).select("session_id", F.col("o")[0].alias("outcome"), F.col("o")[1].alias("confidence"))


def runaway(calls: DataFrame) -> DataFrame:
    """Sessions of 12 or more calls with a run of 5 like calls of which 3 failed, or 12 in a row with 6 failures, or with 3 and one command class 10 times (Q13)."""
    runs = islands(calls, "tool_name", "input")
    sofar = Window.partitionBy("session_id", "run").orderBy("call_index").rowsBetween(Window.unboundedPreceding, 0)
    fail = F.col("failed").cast("int")
    twelve = in_order().rowsBetween(-11, 0)
    runs = runs.withColumn("like", (F.count(F.lit(1)).over(sofar) >= 5) & (F.sum(fail).over(sofar) >= 3))
    runs = runs.withColumn("n", F.count(F.lit(1)).over(twelve)).withColumn("f", F.sum(fail).over(twelve)).withColumn("own", F.collect_list("category").over(twelve))
    most = F.array_max(F.transform(F.array_distinct("own"), lambda c: F.size(F.filter("own", lambda x: x == c))))
    bad = F.col("like") | ((F.col("n") == 12) & ((F.col("f") >= 6) | ((F.col("f") >= 3) & (most >= 10))))
    return runs.groupBy("session_id").agg((F.bool_or(bad) & (F.count(F.lit(1)) >= 12)).alias("runaway"))


def capped(points: Column, most: int) -> Column:
    return F.least(points, F.lit(most))


def score(signals: DataFrame) -> DataFrame:
    """100 less the penalties, 0 at least, and a grade; unknown outcomes of low confidence without tool calls have none (Q14)."""
    c = F.col
    points = (
        F.when(c("outcome") == "errored", 30).when(c("outcome") == "abandoned", 15).otherwise(0)
        + capped(c("failures") * 3, 30) + capped(c("retries") * 5, 25) + capped(c("churned") * 4, 20)
        + F.when(c("longest") >= 3, 10).otherwise(0) + F.when(c("compactions") >= 2, capped((c("compactions") - 1) * 5, 15)).otherwise(0) + F.when(c("runaway"), 5).otherwise(0)
    )
    value = F.when(~((c("outcome") == "unknown") & (c("confidence") == "low") & ~c("has_calls")), F.greatest(100 - points, F.lit(0)))
    grade = F.when(value.isNull(), None)
    for least, name in GRADES:
        grade = grade.when(value >= least, name)
    return signals.withColumns({"score": value.cast("int"), "grade": grade.otherwise("F")})


def call_facts(calls: DataFrame, command_class: str = "category") -> DataFrame:
    """Failures, longest and last run of them, retries, churned files, compactions, peak context and runaway loops of each session (Q2 to Q5, Q13).

    One shuffle by session and one order of its calls serve all: runs are told by where they began, so no run is grouped.
    """
    upto = in_order().rowsBetween(Window.unboundedPreceding, 0)
    at, fail = F.row_number().over(in_order()), F.col("failed").cast("int")
    same = lambda *cs: functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.lag(c).over(in_order())) for c in cs))
    began = lambda c: F.last(F.when(F.col(c), F.col("at")), ignorenulls=True).over(upto)
    rows = calls.withColumns({"at": at, "new_fail": (at == 1) | ~same("failed"), "new_like": (at == 1) | ~same("tool_name", "input"), "failed_upto": F.sum(fail).over(upto),
        "context_before": F.last("context_tokens", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))})
    twelve = in_order().rowsBetween(-11, 0)
    rows = rows.withColumns({"fail_run": F.col("at") - began("new_fail") + 1, "like_run": F.col("at") - began("new_like") + 1,
        "failed_before": F.last(F.when(F.col("new_like"), F.col("failed_upto") - fail), ignorenulls=True).over(upto),
        "w_n": F.count(F.lit(1)).over(twelve), "w_failed": F.sum(fail).over(twelve), "w_class": F.collect_list(command_class).over(twelve)})
    edit = F.col("category").isin("Edit", "Write") & (F.coalesce("file_path", F.lit("")) != "")
    by_file = Window.partitionBy("session_id", "file_path", edit).orderBy("call_index")
    rows = rows.withColumn("third", F.when(edit, F.lag("ordinal", 2).over(by_file)))
    most = F.array_max(F.transform(F.array_distinct("w_class"), lambda c: F.size(F.filter("w_class", lambda x: x == c))))
    bad = ((F.col("like_run") >= 5) & (F.col("failed_upto") - F.col("failed_before") >= 3)) | ((F.col("w_n") == 12) & ((F.col("w_failed") >= 6) | ((F.col("w_failed") >= 3) & (most >= 10))))
    run = F.when(F.col("failed"), F.col("fail_run")).otherwise(0)
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(fail).alias("failures"), F.max(run).cast("long").alias("longest"), F.max_by(run, "at").cast("long").alias("final_streak"),
        F.sum(F.when(F.col("like_run") == 3, 2).when(F.col("like_run") > 3, 1).otherwise(0)).alias("retries"),
        F.count_distinct(F.when(F.col("ordinal") - F.col("third") < 10, F.col("file_path"))).alias("churned"),
        F.count_if((F.col("context_before") > 0) & (F.col("context_tokens") < 0.7 * F.col("context_before"))).alias("compactions"), F.max("context_tokens").alias("peak"),
        (F.bool_or(bad) & (F.count(F.lit(1)) >= 12)).alias("runaway"),
    )


def call_signals(t: Tables) -> DataFrame:
    """Q2 to Q5, Q13 and Q14 for every session of calls alone; its outcome is errored if it ends in three failures, else completed. `prompts.signals` has all signals."""
    out = call_facts(t.calls).withColumns({"outcome": F.when(F.col("final_streak") >= 3, "errored").otherwise("completed"), "confidence": F.lit("medium"), "has_calls": F.lit(True)})
    return score(out).select("session_id", "failures", "longest", "final_streak", "retries", "churned", "compactions", "runaway", "score", "grade")


def grade_distribution(t: Tables) -> DataFrame:
    """Sessions and mean score by grade."""
    return call_signals(t).groupBy("grade").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("score"), 4).alias("mean_score"))


def worst_sessions(t: Tables, signal: str = "failures", limit: int = 10) -> DataFrame:
    """The sessions with most of one signal, ties by id."""
    return call_signals(t).select("session_id", F.col(signal).alias("value")).orderBy(F.desc("value"), "session_id").limit(limit)


def normal(text: Column) -> Column:
    """Code fences out, lower case, white space as one space (Q10)."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "(?s)```.*?```", " ")), r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda w: F.length(w) >= 3)


def prompts(t: Tables) -> DataFrame:
    return t.turns.where("role = 'user' and not is_system").withColumn("norm", normal(F.col("content"))).withColumn("tokens", tokens(F.col("norm")))


def prompt_flags(t: Tables) -> DataFrame:
    """First prompt's length in bytes, whether it is short, and how many prompts lack any number or path (Q11)."""
    own = prompts(t)
    first = F.min_by(F.octet_length("content"), "ordinal")
    return own.groupBy("session_id").agg(first.cast("long").alias("first_bytes"), (first < 30).alias("short_start"), F.count_if(~F.col("content").rlike("[0-9/]")).alias("no_reference"))


#: Prompts are alike from this overlap on. Of the later one's mass and the earlier one's together, LIKE / (1 + LIKE) is shared then.
LIKE = 0.85


def like_prompts(base: DataFrame) -> DataFrame:
    """session_id, later, earlier: prompts (session_id, ordinal, tokens) of an overlap of LIKE.

    The overlap counts repeated tokens of the earlier prompt, so that a share of LIKE / (1 + LIKE) of them at least is among the later one's: of its
    rarest tokens, those that make up more than the rest have one in common with it. These are joined with the later prompts' tokens, and candidates confirmed.
    """
    n = base.select("session_id", "ordinal", F.size("tokens").alias("size"), F.explode("tokens").alias("w")).groupBy("session_id", "ordinal", "size", "w").agg(F.count(F.lit(1)).alias("c"))
    n = staged(n)
    seen = n.groupBy("session_id", "w").agg(F.count(F.lit(1)).alias("seen"))
    order = Window.partitionBy("session_id", "ordinal").orderBy("seen", "w")
    rare = n.join(staged(seen), ["session_id", "w"]).withColumn("before", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    rare = rare.where(F.col("before") <= F.col("size") * (1 / (1 + LIKE) + 1e-9)).select("session_id", "w", F.col("ordinal").alias("earlier"), F.col("size").alias("e_size"))
    # The later one's distinct tokens and the earlier one's all: neither can be so long that the other can't reach LIKE of it.
    near = n.select("session_id", "w", F.col("ordinal").alias("later")).join(rare, ["session_id", "w"]).where("earlier < later").select("session_id", "later", "earlier").distinct()
    text = base.select("session_id", "ordinal", "tokens")
    both = near.join(text.withColumnsRenamed({"ordinal": "later", "tokens": "a"}), ["session_id", "later"]).join(text.withColumnsRenamed({"ordinal": "earlier", "tokens": "b"}), ["session_id", "earlier"])
    own = F.array_distinct("a")
    shared = F.size(F.filter("b", lambda w: F.array_contains(own, w)))
    return both.where(shared / (F.size(own) + F.size("b") - shared) >= LIKE).select("session_id", "later", "earlier")


def duplicate_prompts(t: Tables) -> DataFrame:
    """Prompts that repeat an earlier kept one: equal, or of a token overlap of 0.85; in order, so that only kept ones are compared with (Q12).

    Equal prompts count at once. Of the others, one without an earlier like it is kept, one with a kept earlier one is not; that settles more in each
    round, until none is open. No session is gathered anywhere.
    """
    own = prompts(t).where((F.octet_length("norm") >= 20) & (F.size("tokens") >= 4))
    base = staged(own.groupBy("session_id", "norm").agg(F.min("ordinal").alias("ordinal"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens")).drop("norm"))
    pairs, dropped = staged(like_prompts(base)), None
    ids = lambda df, c: df.select("session_id", F.col(c).alias("ordinal")).distinct()
    while pairs.take(1):
        kept = ids(pairs, "earlier").join(ids(pairs, "later"), ["session_id", "ordinal"], "left_anti")
        gone = staged(ids(pairs.join(kept.withColumnRenamed("ordinal", "earlier"), ["session_id", "earlier"], "left_semi"), "later"))
        dropped = gone if dropped is None else dropped.unionByName(gone)
        pairs = pairs.join(gone.withColumnRenamed("ordinal", "later"), ["session_id", "later"], "left_anti")
        pairs = staged(pairs.join(gone.withColumnRenamed("ordinal", "earlier"), ["session_id", "earlier"], "left_anti"))
    out = base.groupBy("session_id").agg(F.sum(F.col("copies") - 1).alias("again"))
    if dropped is None:
        return out.select("session_id", F.col("again").cast("int").alias("repeats"))
    return out.join(dropped.groupBy("session_id").agg(F.count(F.lit(1)).alias("like")), "session_id", "left").select("session_id", (F.col("again") + F.coalesce("like", F.lit(0))).cast("int").alias("repeats"))


def frustration(t: Tables) -> DataFrame:
    """User prompts that shout: three exclamation marks, or 0.4 of their words of two letters or more in capitals, code fences left out."""
    words = F.filter(F.split(F.regexp_replace("content", "(?s)```.*?```", " "), r"[ \t\n]+"), lambda w: w.rlike("^[A-Za-z]{2,}$"))
    caps = F.filter(words, lambda w: w == F.upper(w))
    shouts = F.col("content").contains("!!!") | ((F.size(words) > 0) & (F.size(caps) >= 0.4 * F.size(words)))
    return t.turns.where("role = 'user'").groupBy("session_id").agg(F.count_if(shouts).alias("markers"))
