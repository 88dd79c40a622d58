"""The activity report over a range of time: ranges and buckets by time zone, agents and usage in each bucket, sessions, breakdowns, totals.

A report's windows are at most MAX_WINDOWS; they are the only thing that is sent about. Spans are swept once, over all windows
(concurrency.levels); a window's figures are those of the levels that it overlaps, so no task has all the instants of a window.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import place_among
from ..sources.tables import Tables
from . import concurrency, usage

#: The longest range, the most windows, and the bucket's seconds for ranges up to so many seconds.
MAX_DAYS, MAX_WINDOWS = 365, 2000
BUCKETS = [(36 * 3600, 300), (14 * 86400, 3600), (90 * 86400, 86400)]
WEEK = 604_800
OVERRIDES = {"5m": 300, "15m": 900, "1h": 3600, "1d": 86400, "1w": WEEK}


class Report(NamedTuple):
    """A resolved range in UTC microseconds. until: its end, or now if that is before; starts, ends: of the windows."""

    start: int
    end: int
    until: int
    seconds: int
    starts: list[int]
    ends: list[int]


def preset_range(preset: Column, date: Column, zone: str) -> tuple[Column, Column]:
    """UTC timestamps where the day, ISO week or month of a civil date in a time zone starts and ends; nulls for another preset."""
    first = F.when(preset == "day", date).when(preset == "week", F.date_trunc("week", date).cast("date")).when(preset == "month", F.date_trunc("month", date).cast("date"))
    last = F.when(preset == "day", F.date_add(first, 1)).when(preset == "week", F.date_add(first, 7)).when(preset == "month", F.add_months(first, 1))
    return F.to_utc_timestamp(first.cast("timestamp"), zone), F.to_utc_timestamp(last.cast("timestamp"), zone)


def bucket_seconds(start: Column, end: Column) -> Column:
    """The nominal size of a range's buckets."""
    length, out = F.unix_seconds(end) - F.unix_seconds(start), None
    for most, size in BUCKETS:
        out = F.when(length <= most, size) if out is None else out.when(length <= most, size)
    return out.otherwise(WEEK)


def resolve(spark: SparkSession, preset: str = "day", date: str = "", start: str = "", end: str = "", zone: str = "UTC", bucket: str = "", now: str = "") -> Report:
    """A preset by date, or custom with start and end (UTC), cut into windows of a size that follows from its length, or `bucket`.

    Windows of minutes and hours have a fixed length; those of days and weeks follow the zone's calendar, so a day has 23 or 25 hours where
    clocks change. The first and the last are clipped to the range.
    """
    one, utc = spark.range(1), lambda x: F.lit(x).cast("timestamp")
    bounds = (utc(start), utc(end)) if preset == "custom" else preset_range(F.lit(preset), F.lit(date).cast("date"), zone)
    lo, hi, seconds, at = one.select(*map(F.unix_micros, bounds), bucket_seconds(*bounds), F.unix_micros(utc(now or None))).first()
    if lo is None or hi is None or lo >= hi:
        raise ValueError("the range needs a start before its end")
    if hi - lo > MAX_DAYS * 86_400_000_000:
        raise ValueError("the range exceeds a year")
    if bucket and bucket not in OVERRIDES:
        raise ValueError(f"no such bucket: {bucket}")
    seconds = OVERRIDES[bucket] if bucket else seconds
    if (hi - lo) // 1_000_000 > seconds * MAX_WINDOWS:
        raise ValueError("too many buckets")
    if seconds < 86400:
        edges = [*range(lo, hi, seconds * 1_000_000), hi]
    else:
        step = seconds // 86400
        local = lambda us: F.from_utc_timestamp(F.timestamp_micros(F.lit(us)), zone).cast("date")
        day = F.date_trunc("week", local(lo)).cast("date") if step == 7 else local(lo)
        days = one.select(F.explode(F.sequence(day, F.date_add(local(hi), step), F.expr(f"interval {step} day"))).alias("d"))
        found = days.select(F.unix_micros(F.to_utc_timestamp(F.col("d").cast("timestamp"), zone))).orderBy("d").collect()  # MAX_WINDOWS at most
        edges = [lo, *(x for (x,) in found if lo < x < hi), hi]
    return Report(lo, hi, hi if at is None else max(lo, min(hi, at)), seconds, edges[:-1], edges[1:])


def within(t: Tables, r: Report) -> Tables:
    """The messages of the range, up to now."""
    at = F.unix_micros("ts")
    return t._replace(messages=t.messages.where((at >= r.start) & (at < r.until)))


def spans(t: Tables, r: Report) -> DataFrame:
    """Active intervals clipped to the range, up to now (R2)."""
    cut = concurrency.intervals(t).withColumns({"lo": F.greatest("lo", F.lit(r.start)), "hi": F.least("hi", F.lit(r.until))})
    return cut.where("lo < hi")


def windows(spark: SparkSession, r: Report) -> DataFrame:
    return spark.createDataFrame(list(zip(range(len(r.starts)), r.starts, r.ends, strict=True)), "window int, lo long, hi long")


def cut_up(rows: DataFrame, r: Report) -> DataFrame:
    """Rows [lo, hi) cut at the windows' bounds, with the window's number."""
    first, last = place_among(F.col("lo"), r.starts) - 1, place_among(F.col("hi"), r.starts, at=False) - 1
    cut = rows.withColumn("window", F.explode(F.sequence(first, last)))
    bound = lambda edges: F.get(F.array(*map(F.lit, edges)), F.col("window"))
    return cut.withColumns({"lo": F.greatest("lo", bound(r.starts)), "hi": F.least("hi", bound(r.ends))})


def usage_in_windows(t: Tables, r: Report) -> DataFrame:
    """Output tokens and cost of what survives within the range, by the window that holds its time."""
    rows = usage.survivors(within(t, r)).withColumn("window", (place_among(F.unix_micros("ts"), r.starts) - 1).cast("int"))
    return rows.groupBy("window").agg(F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))


def buckets(t: Tables, r: Report) -> DataFrame:
    """Every window with agent minutes, most agents at once and how many of these are automated and interactive, tokens and cost."""
    levels = concurrency.levels(spans(t, r).withColumn("kind", F.when(F.col("is_automated"), 1).otherwise(0)), "kind")
    parts = cut_up(levels.where("open > 0").select("open", "kind", F.col("at").alias("lo"), F.col("next").alias("hi")), r)
    top = F.min_by(F.struct("open", "kind"), F.struct((-F.col("open")).alias("o"), "lo"))
    own = parts.groupBy("window").agg(F.round(F.sum(F.col("open") * (F.col("hi") - F.col("lo"))) / 6e7, 4).alias("agent_minutes"), top.alias("top"))
    out = windows(t.messages.sparkSession, r).join(own, "window", "left").join(usage_in_windows(t, r), "window", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        F.col("lo").alias("start"), F.col("hi").alias("end"), F.coalesce("agent_minutes", F.lit(0.0)).alias("agent_minutes"), n(F.col("top.open")).alias("max_agents"),
        n(F.col("top.kind")).alias("automated_at_peak"), n(F.col("top.open") - F.col("top.kind")).alias("interactive_at_peak"), n(F.col("output_tokens")).alias("output_tokens"), n(F.col("cost")).alias("cost"),
    )


def session_minutes(t: Tables, r: Report) -> DataFrame:
    return spans(t, r).groupBy("session_id", "model").agg(F.sum(F.col("hi") - F.col("lo")).alias("us"), F.min("lo").alias("first"), F.max("hi").alias("last"))


def session_costs(t: Tables, r: Report) -> DataFrame:
    return usage.survivors(within(t, r)).groupBy("session_id", "model").agg(F.sum("cost").alias("cost"), F.sum("output_tokens").alias("output_tokens"))


def listed(models: str, weight: str) -> tuple[Column, Column]:
    """The model of the greatest weight (the first by name if none has any, or two have the same), and all of them, sorted; unknown ones left out."""
    known = F.when(~F.col(models).isin("", "unknown"), F.struct((-F.greatest(F.col(weight), F.lit(0))).alias("w"), F.col(models).alias("model")))
    return F.min(known)["model"], F.array_join(F.array_sort(F.collect_set(F.when(~F.col(models).isin("", "unknown"), F.col(models)))), ",")


def sessions(t: Tables, r: Report) -> DataFrame:
    """Sessions with a message in the range: minutes, first and last instant, models by minutes, else by cost, tokens and cost."""
    own = within(t, r).messages.groupBy("session_id").agg(F.first("project").alias("project"), F.first("agent").alias("agent"), F.first("is_automated").alias("is_automated"))
    best, names = listed("model", "us")
    minutes = session_minutes(t, r).groupBy("session_id").agg(F.round(F.sum("us") / 6e7, 4).alias("minutes"), F.min("first").alias("first"), F.max("last").alias("last"), best.alias("m_model"), names.alias("m_models"))
    best, names = listed("model", "cost")
    cost = session_costs(t, r).groupBy("session_id").agg(F.sum("cost").alias("cost"), F.sum("output_tokens").alias("output_tokens"), best.alias("c_model"), names.alias("c_models"))
    out = own.join(minutes, "session_id", "left").join(cost, "session_id", "left")
    pick = lambda c: F.when(F.col("m_model").isNotNull(), F.col(f"m_{c}")).otherwise(F.col(f"c_{c}"))
    return out.select(
        "session_id", "project", "agent", "is_automated", F.when(F.col("minutes").isNull(), "untimed").otherwise("timed").alias("timing"), "minutes", "first", "last",
        F.coalesce(pick("model"), F.lit("")).alias("primary_model"), F.coalesce(pick("models"), F.lit("")).alias("models"), F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
    )


def breakdowns(t: Tables, r: Report) -> DataFrame:
    """Minutes and cost by project, agent and model, automated and interactive; keys without a name or without both left out."""
    kinds = t.sessions.select("session_id", "project", "agent", "is_automated")
    zero = F.lit(0).cast("long")
    rows = session_minutes(t, r).select("session_id", "model", "us", zero.alias("cost")).unionByName(session_costs(t, r).select("session_id", "model", zero.alias("us"), "cost"))
    side = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ("project", "agent", "model"))))
    auto = lambda c, yes: F.sum(F.when(F.col("is_automated") if yes else ~F.col("is_automated"), F.col(c)).otherwise(0))
    us = lambda yes: F.round(auto("us", yes) / 6e7, 4)
    out = rows.join(kinds, "session_id").withColumn("side", side).groupBy("side.kind", "side.label").agg(
        us(True).alias("automated_minutes"), us(False).alias("interactive_minutes"), auto("cost", True).alias("automated_cost"), auto("cost", False).alias("interactive_cost"), F.sum("us").alias("us"), F.sum("cost").alias("cost")
    )
    return out.where("label <> '' and (us <> 0 or cost <> 0) and not (kind = 'model' and label = 'unknown')").drop("us", "cost")


def totals(t: Tables, r: Report) -> DataFrame:
    """Active, idle and agent minutes, sessions by kind, distinct projects and models, tokens and cost by kind."""
    levels = concurrency.levels(spans(t, r))
    swept = levels.agg(F.round(F.sum(F.when(F.col("open") > 0, F.col("next") - F.col("at"))) / 6e7, 4).alias("active"), F.round(F.sum(F.col("open") * (F.col("next") - F.col("at"))) / 6e7, 4).alias("agent_minutes"))
    s, auto = sessions(t, r), F.col("is_automated")
    names = F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("models") != "", F.split("models", ","))))))  # sets of model names: few
    own = s.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(auto).alias("automated"), F.count_if(F.col("timing") == "untimed").alias("untimed"), F.count_distinct("project").alias("projects"), names.cast("long").alias("models"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.sum(F.when(auto, F.col("cost")).otherwise(0)).alias("automated_cost"),
    )
    idle = F.round((r.until - r.start) / 6e7 - F.coalesce("active", F.lit(0.0)), 4)
    return own.join(F.broadcast(swept)).withColumn("idle", idle)  # one row each
