"""Dashboard aggregates over sessions, messages and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import bucket, counted, counted_median, counted_percentile, exact_percentile, half_away, ranked
from ..functions.storage import staged
from ..sources.tables import Tables
from .filters import analytics_filter, visible

#: Seconds: the longest gap that counts as activity, the longest turn cycle.
GAP, CYCLE = 300, 1800
LENGTHS = [(5, "1-5"), (15, "6-15"), (30, "16-30"), (60, "31-60"), (120, "61-120")]
MINUTES = [(5, "<5m"), (15, "5-15m"), (30, "15-30m"), (60, "30-60m"), (120, "1-2h")]
AUTONOMY = [(0.5, "<0.5"), (1, "0.5-1"), (2, "1-2"), (5, "2-5"), (10, "5-10")]


def day(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def seconds(a: str, b: str) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def summary(t: Tables) -> DataFrame:
    """One row over the filtered sessions: counts, mean, median, p90, share of the three largest projects, most active project (A1)."""
    own = analytics_filter(t)
    first = own.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("message_count").alias("messages"), F.sum("total_output_tokens").alias("output_tokens"),
        F.count_distinct("project").alias("projects"), F.count_distinct(day("started_at")).alias("days"), half_away(F.avg("message_count"), 1).alias("avg_messages"),
    )
    places = counted(own, "message_count").agg(counted_median("message_count").alias("median_messages"), counted_percentile("message_count", 0.9).alias("p90_messages"))
    first = first.join(F.broadcast(places))  # one row each
    by = own.groupBy("project").agg(F.sum("message_count").alias("n"))
    top = by.orderBy(F.desc("n"), "project").limit(3).agg(F.sum("n").alias("top3"))
    most = by.orderBy(F.desc("n"), "project").limit(1).select(F.col("project").alias("most_active"))
    one = first.join(F.broadcast(top)).join(F.broadcast(most), how="left")  # each side has one row
    return one.select(*first.columns, half_away(F.col("top3") / F.col("messages"), 3).alias("concentration"), "most_active")


def by_agent(t: Tables) -> DataFrame:
    return analytics_filter(t).groupBy("agent").agg(F.count(F.lit(1)).alias("sessions"), F.sum("message_count").alias("messages"))


def activity(t: Tables, unit: str = "week") -> DataFrame:
    """Per day, week or month: messages by role, thinking, tool use, distinct sessions (A2)."""
    own = t.messages.join(analytics_filter(t).select("session_id"), "session_id", "left_semi")
    n = lambda c, name: F.count_if(c).alias(name)
    return own.groupBy(F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd").alias("bucket")).agg(
        F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("messages"), n(F.col("role") == "user", "user"), n(F.col("role") == "assistant", "assistant"), n(F.col("has_thinking"), "thinking"), n(F.col("has_tool_use"), "tool_use"))


def heatmap(t: Tables, first: str = "2024-01-01", last: str = "2024-01-31") -> DataFrame:
    """Messages of each calendar day, zero-filled, with a level 0 to 4 by the places of quartiles among positive days (A3)."""
    return levelled(t.messages.groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("v")), first, last)


def levelled(counts: DataFrame, first: str, last: str) -> DataFrame:
    """Days (d, v) from first to last with their level; a year at most, so they may be put in order at once."""
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    days = spine.join(counts, "d", "left").na.fill(0, ["v"])
    at = lambda q: F.coalesce(F.max(F.when(F.col("rank") == F.floor(F.col("n") * q), F.col("v"))), F.lit(0))
    levels = ranked(days.where("v > 0"), "v").agg(at(0.25).alias("l2"), at(0.5).alias("l3"), at(0.75).alias("l4"))
    level = F.when(F.col("v") <= 0, 0).when(F.col("v") <= F.col("l2"), 1).when(F.col("v") <= F.col("l3"), 2).when(F.col("v") <= F.col("l4"), 3).otherwise(4)
    return days.join(F.broadcast(levels)).select(F.date_format("d", "yyyy-MM-dd").alias("date"), F.col("v").alias("value"), level.alias("level"))


def projects(t: Tables) -> DataFrame:
    """Sessions, messages, dates, mean, median and messages of an active day for each project (A4)."""
    own = analytics_filter(t)
    out = own.groupBy("project").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("message_count").alias("messages"), F.min(day("started_at")).alias("first"), F.max(day("started_at")).alias("last"),
        half_away(F.avg("message_count"), 1).alias("mean"), F.count_distinct(day("started_at")).alias("days"))
    middle = counted(own, "message_count", "project").groupBy(F.col("project").alias("p")).agg(counted_median("message_count").alias("median"))
    return out.join(middle, F.col("project").eqNullSafe(F.col("p"))).drop("p").withColumn("daily", half_away(F.col("messages") / F.col("days"), 1))


def hour_of_week(t: Tables) -> DataFrame:
    """Messages in each of 7 x 24 local cells, zero-filled (A5)."""
    cells = t.messages.sparkSession.range(168).select((F.floor(F.col("id") / 24)).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"))
    own = t.messages.join(analytics_filter(t).select("session_id"), "session_id", "left_semi").groupBy(F.weekday("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("messages"))
    return F.broadcast(cells).join(own, ["day", "hour"], "left").na.fill(0, ["messages"])


def shape(t: Tables) -> DataFrame:
    """Histograms of sessions' length, duration and autonomy (tool turns for each user turn)."""
    tools = t.messages.groupBy("session_id").agg(F.count_if("has_tool_use").alias("tools"))
    own = analytics_filter(t).join(tools, "session_id")
    kinds = F.array(
        F.struct(F.lit("length").alias("kind"), bucket(F.col("message_count"), LENGTHS, "121+", closed=True).alias("label")),
        F.struct(F.lit("duration").alias("kind"), bucket(seconds("started_at", "ended_at") / 60, MINUTES, "2h+").alias("label")),
        F.struct(F.lit("autonomy").alias("kind"), bucket(F.col("tools") / F.col("user_message_count"), AUTONOMY, "10+").alias("label")),
    )
    return own.withColumn("k", F.explode(kinds)).groupBy("k.kind", "k.label").agg(F.count(F.lit(1)).alias("sessions"))


def tools(t: Tables) -> DataFrame:
    """Calls, sessions and share of all calls by category and tool."""
    out = t.calls.groupBy("category", "tool_name").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("session_id").alias("sessions"))
    return out.withColumn("pct", half_away(100 * F.col("calls") / F.sum("calls").over(Window.partitionBy()), 1))


def skills(t: Tables) -> DataFrame:
    """Calls, sessions and last use of each skill."""
    return t.calls.where("skill <> ''").groupBy("skill").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("session_id").alias("sessions"), F.max(day()).alias("last_used"))


def steps(messages: DataFrame) -> DataFrame:
    own = Window.partitionBy("session_id").orderBy("ordinal")
    return messages.withColumn("before", F.lag("ts").over(own)).withColumn("role_before", F.lag("role").over(own)).withColumn("gap", seconds("before", "ts"))


def velocity(t: Tables) -> DataFrame:
    """p50 and p90 of turn cycles (user to assistant, positive, up to 1800 s), messages and characters for each active minute; overall and by agent."""
    rows = steps(t.messages).withColumn("label", F.explode(F.array(F.lit("all"), F.col("agent"))))
    turns = staged(rows.where((F.col("role") == "assistant") & (F.col("role_before") == "user") & (F.col("gap") > 0) & (F.col("gap") <= CYCLE)).select("label", "gap"))
    p = {k: exact_percentile(turns, "gap", k, "label").withColumnRenamed("gap", f"p{int(100 * k)}") for k in (0.5, 0.9)}
    cycles = p[0.5].withColumnRenamed("n", "cycles").join(p[0.9].drop("n"), "label")
    rates = rows.groupBy("label").agg(F.sum(F.least("gap", F.lit(float(GAP)))).alias("active"), F.count(F.lit(1)).alias("messages"), F.sum("content_length").alias("chars"))
    per = lambda c: F.round(F.col(c) / (F.col("active") / 60), 4).alias(f"{c}_per_minute")
    return rates.join(cycles, "label", "left").select("label", F.round("p50", 3).alias("p50"), F.round("p90", 3).alias("p90"), "cycles", per("messages"), per("chars"))


def top_sessions(t: Tables, limit: int = 10) -> DataFrame:
    """The sessions of the longest active time: the sum of gaps, each capped (A10)."""
    active = steps(t.messages).groupBy("session_id").agg(F.round(F.coalesce(F.sum(F.least("gap", F.lit(float(GAP)))), F.lit(0.0)), 3).alias("active_seconds"))
    return visible(t.sessions).join(active, "session_id").select("session_id", "project", "active_seconds", "message_count").orderBy(F.desc("active_seconds"), "session_id").limit(limit)


def archive_stats(t: Tables) -> DataFrame:
    """Totals over root sessions."""
    return visible(t.sessions).agg(F.count(F.lit(1)).alias("sessions"), F.sum("message_count").alias("messages"), F.count_distinct("project").alias("projects"), F.count_distinct("machine").alias("machines"), day_min("started_at").alias("earliest"))


def day_min(ts: str) -> Column:
    return F.date_format(F.min(ts), "yyyy-MM-dd")


def dimensions(t: Tables) -> DataFrame:
    """Sessions by project, agent, machine and branch."""
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ("project", "agent", "machine", "branch"))))
    return visible(t.sessions).withColumn("side", sides).groupBy("side.kind", "side.label").agg(F.count(F.lit(1)).alias("sessions"))


def inventory(t: Tables) -> DataFrame:
    """Sessions, machines, agents, working directories and days of each project."""
    return t.sessions.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("machine").alias("machines"), F.count_distinct("agent").alias("agents"), F.count_distinct("cwd").alias("cwds"), day_min("started_at").alias("first"), F.date_format(F.max("ended_at"), "yyyy-MM-dd").alias("last"))


def models_used(t: Tables) -> DataFrame:
    """Models in the filtered sessions."""
    return t.messages.where("model <> ''").join(analytics_filter(t).select("session_id"), "session_id", "left_semi").select("model").distinct()


def resume_models(t: Tables) -> DataFrame:
    """Assistant messages by session and model."""
    return t.messages.where("role = 'assistant' and model <> '<synthetic>'").groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("messages"))


def archetypes(t: Tables) -> DataFrame:
    """Sessions by archetype of their user messages: quick, standard, deep, marathon (B2)."""
    label = bucket(F.col("user_message_count"), [(5, "quick"), (15, "standard"), (50, "deep")], "marathon", closed=True)
    return visible(t.sessions).where("not is_automated").groupBy(label.alias("archetype")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("message_count").alias("messages"))


def distributions(t: Tables) -> DataFrame:
    """Mean and histogram of user messages, for all and for human sessions; half-open edges."""
    edges = [(2, "0-1"), (6, "2-5"), (16, "6-15"), (51, "16-50")]
    own = visible(t.sessions).withColumn("scope", F.explode(F.when(F.col("is_automated"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("human")))))
    n = own.groupBy("scope", bucket(F.col("user_message_count"), edges, "51+").alias("label")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("user_message_count").alias("s"))
    up = Window.partitionBy("scope")
    return n.select("scope", "label", "sessions", F.round(F.sum("s").over(up) / F.sum("sessions").over(up), 6).alias("mean"))


def model_mix(t: Tables) -> DataFrame:
    """Output tokens by model, zeroes dropped."""
    return t.messages.where("model <> ''").groupBy("model").agg(F.sum("output_tokens").alias("output_tokens")).where("output_tokens > 0")


def portfolio(t: Tables) -> DataFrame:
    """Sessions, messages and tokens by agent, all and human, and which agent is first."""
    human = ~F.col("is_automated")
    out = t.sessions.groupBy("agent").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(human).alias("human_sessions"), F.sum("message_count").alias("messages"), F.sum("total_output_tokens").alias("tokens"))
    return out.withColumn("is_primary", F.row_number().over(Window.orderBy(F.desc("sessions"), "agent")) == 1)  # one row for each agent


def cache_economics(t: Tables) -> DataFrame:
    """Sessions by cache hit ratio reads / (input + reads + writes), in tenths; 1 belongs to the last."""
    own = t.messages.where("role = 'assistant'").groupBy("session_id").agg(F.sum("cache_read").alias("r"), F.sum(F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation")).alias("n")).where("n > 0")
    return own.groupBy(F.least(F.floor(F.col("r") * 10 / F.col("n")), F.lit(9)).cast("int").alias("tenth")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("r").alias("reads"), F.sum("n").alias("total"))


def hourly(t: Tables) -> DataFrame:
    """User messages and sessions by UTC hour."""
    return t.messages.where("role = 'user'").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("session_id").alias("sessions"))


def first_responses(messages: DataFrame) -> DataFrame:
    """session_id, gap: seconds from a session's first user message to the first assistant message after it, none below 0."""
    asked = messages.where("role = 'user'").groupBy("session_id").agg(F.min_by(F.struct("ordinal", "ts"), "ordinal").alias("a"))
    said = messages.where("role = 'assistant'").join(asked, "session_id").where(F.col("ordinal") > F.col("a.ordinal")).groupBy("session_id").agg(F.min_by(F.struct("ordinal", "ts"), "ordinal").alias("b"), F.first("a").alias("a"))
    return said.select("session_id", F.greatest(seconds("a.ts", "b.ts"), F.lit(0.0)).alias("gap"))


def velocity_block(t: Tables) -> DataFrame:
    """p50, p90 and mean of turn cycles and of first responses over visible sessions, and how many of either there are."""
    own = t.messages.join(visible(t.sessions).select("session_id"), "session_id", "left_semi")
    cycles = steps(own).where((F.col("role") == "assistant") & (F.col("role_before") == "user") & (F.col("gap") > 0) & (F.col("gap") <= CYCLE)).select("gap")
    out = None
    for name, rows in (("cycle", staged(cycles)), ("response", staged(first_responses(own).select("gap")))):
        one = rows.agg(F.count(F.lit(1)).alias(f"{name}s"), F.round(F.avg("gap"), 4).alias(f"{name}_mean"))
        for p in (0.5, 0.9):
            one = one.join(F.broadcast(exact_percentile(rows, "gap", p).select(F.round("gap", 4).alias(f"{name}_p{int(100 * p)}"))), how="left")  # one row each
        out = one if out is None else out.join(F.broadcast(one))
    return out


def day_metric(t: Tables, metric: str, first: str = "2024-01-01", last: str = "2024-01-31") -> DataFrame:
    """sessions (by start), messages or output_tokens of each calendar day, zero-filled, with levels as in `heatmap` (A3)."""
    rows, value = {"sessions": (t.sessions.withColumn("ts", F.col("started_at")), F.count(F.lit(1))), "messages": (t.messages, F.count(F.lit(1))), "output_tokens": (t.messages, F.sum("output_tokens"))}[metric]
    return levelled(rows.groupBy(F.to_date("ts").alias("d")).agg(value.cast("long").alias("v")), first, last)


def top_by(t: Tables, metric: str, limit: int = 10) -> DataFrame:
    """The sessions with most messages or output tokens, ties by id (A10); `top_sessions` ranks them by active time."""
    column = {"messages": "message_count", "output_tokens": "total_output_tokens"}[metric]
    return visible(t.sessions).select("session_id", "project", F.col(column).alias("value")).orderBy(F.desc("value"), "session_id").limit(limit)


def call_times(calls: DataFrame, messages: DataFrame) -> DataFrame:
    """Calls by week of the message (session_id, ordinal, ts) that made them and by category; a call without its message, or whose message has no time, counts under no week."""
    at = messages.select("session_id", "ordinal", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"))
    return calls.join(at, ["session_id", "ordinal"], "left").groupBy("week", "category").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("session_id").alias("sessions"))


#: Sessions by their number of messages.
COMPLEXITY = [(15, "1-15"), (60, "16-60")]


def velocity_by(t: Tables) -> DataFrame:
    """Cycles and first responses (p50, p90), and messages, characters and tool turns for each active minute, over all, by agent and by complexity."""
    sides = lambda: F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("label")), F.struct(F.lit("agent").alias("kind"), F.col("agent").alias("label")), F.struct(F.lit("complexity").alias("kind"), bucket(F.col("message_count"), COMPLEXITY, "61+", closed=True).alias("label")))
    own = t.sessions.select("session_id", "message_count", F.col("agent").alias("s_agent"))
    rows = steps(t.messages).join(own, "session_id").withColumn("s", F.explode(sides())).select("s.kind", "s.label", "role", "role_before", "gap", "content_length", "has_tool_use")
    cycle = (F.col("role") == "assistant") & (F.col("role_before") == "user") & (F.col("gap") > 0) & (F.col("gap") <= CYCLE)
    answered = first_responses(t.messages).join(own.withColumnRenamed("s_agent", "agent"), "session_id").withColumn("s", F.explode(sides())).select("s.kind", "s.label", "gap")
    out = rows.groupBy("kind", "label").agg(F.sum(F.least("gap", F.lit(float(GAP)))).alias("active"), F.count(F.lit(1)).alias("messages"), F.sum("content_length").alias("chars"), F.count_if("has_tool_use").alias("tool_turns"))
    per = lambda c: F.round(F.col(c) / (F.col("active") / 60), 4).alias(f"{c}_per_minute")
    out = out.select("kind", "label", *(per(c) for c in ("messages", "chars", "tool_turns")))
    for name, part in (("cycle", staged(rows.where(cycle).select("kind", "label", "gap"))), ("response", staged(answered))):
        for p in (0.5, 0.9):
            out = out.join(exact_percentile(part, "gap", p, "kind", "label").select("kind", "label", F.round("gap", 3).alias(f"{name}_p{int(100 * p)}")), ["kind", "label"], "left")
    return out


def tool_mix(calls: DataFrame) -> DataFrame:
    """Calls and sessions by agent and category, with the share of the agent's calls."""
    n = calls.groupBy("agent", "category").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("session_id").alias("sessions"))
    return n.withColumn("pct", half_away(100 * F.col("calls") / F.sum("calls").over(Window.partitionBy("agent")), 1))  # a row for each agent and category


def trend(calls: DataFrame, column: str) -> DataFrame:
    """Calls by week and tool category, or by week and skill."""
    return calls.where(F.col(column) != "").groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), column).agg(F.count(F.lit(1)).alias("calls"))


def skill_mix(calls: DataFrame) -> DataFrame:
    """Calls of each skill by agent and by project, with the share of the skill's calls."""
    side = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ("agent", "project"))))
    n = calls.where("skill <> ''").withColumn("side", side).groupBy("skill", "side.kind", "side.label").agg(F.count(F.lit(1)).alias("calls"))
    return n.withColumn("pct", half_away(100 * F.col("calls") / F.sum("calls").over(Window.partitionBy("skill", "kind")), 1))  # a row for each skill and label
