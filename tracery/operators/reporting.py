"""A day of the archive by hours: activity, usage, what was first seen, and digests that tell whether anything changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000  # microseconds
#: How well a source tells when a session was first seen on the day.
RANKS = ["interval", "usage", "event", "start", "created"]


def _day(date: str) -> tuple[Column, Column]:
    start = F.unix_micros(F.lit(f"{date} 00:00:00").cast("timestamp"))
    return start, start + DAY


def session_first(date: str, spans: DataFrame, usage: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, at, source: when each session was first seen on a day, by the best source that has it then.

    spans: session_id, lo, hi; a span that began before counts from the day's start. usage and events: session_id, ts. sessions: session_id,
    started_at, created_at. All sources of a session meet in one aggregation, as a rank and an instant each.
    """
    low, high = _day(date)
    at = lambda c: F.unix_micros(c)
    clipped = spans.select("session_id", F.greatest("lo", low).alias("at")).where((F.least("hi", high) > F.greatest("lo", low)) & (F.col("lo") < high))
    parts = [clipped, usage.select("session_id", at("ts").alias("at")), events.select("session_id", at("ts").alias("at")), sessions.select("session_id", at("started_at").alias("at")), sessions.select("session_id", at("created_at").alias("at"))]
    rows = None
    for rank, part in enumerate(parts):
        own = part.where((F.col("at") >= low) & (F.col("at") < high)).select("session_id", F.struct(F.lit(rank).alias("rank"), "at").alias("f"))
        rows = own if rows is None else rows.unionByName(own)
    best = rows.groupBy("session_id").agg(F.min("f").alias("f"))
    return best.select("session_id", F.col("f.at").alias("at"), F.element_at(F.array(*map(F.lit, RANKS)), F.col("f.rank") + 1).alias("source"))


def first_seen(date: str, spans: DataFrame, usage: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """hour, new_sessions, automated, interactive, untimed (without a span), new_projects, new_models of the hours that have any.

    sessions also have project and is_automated; usage and events have model. A project is first seen with its first session.
    """
    low, high = _day(date)
    hour = lambda c: F.floor((c - low) / HOUR).alias("hour")
    seen = session_first(date, spans, usage, events, sessions).join(sessions.select("session_id", "project", F.coalesce("is_automated", F.lit(False)).alias("auto")), "session_id", "left")
    n = F.count(F.lit(1))
    new = seen.groupBy(hour(F.col("at"))).agg(n.alias("new_sessions"), F.count_if(F.coalesce("auto", F.lit(False))).alias("automated"), F.count_if(~F.coalesce("auto", F.lit(False))).alias("interactive"), F.count_if(F.col("source") != "interval").alias("untimed"))
    projects = seen.where("project <> ''").groupBy("project").agg(F.min("at").alias("at")).groupBy(hour(F.col("at"))).agg(n.alias("new_projects"))
    named = events.select("model", F.unix_micros("ts").alias("at")).unionByName(usage.select("model", F.unix_micros("ts").alias("at")))
    models = named.where((F.col("model") != "") & (F.col("at") >= low) & (F.col("at") < high)).groupBy("model").agg(F.min("at").alias("at")).groupBy(hour(F.col("at"))).agg(n.alias("new_models"))
    return new.join(projects, "hour", "full").join(models, "hour", "full").na.fill(0)


def reporting_day(date: str, spans: DataFrame, usage: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The day's 24 hours (UTC) with activity, usage and first-seen counts, a digest of each and one of the day (K3).

    Agent time is that of spans within the hour (microseconds). usage also has output_tokens. An hour's digest is that of its named fields in a fixed
    order; the day's is that of the 24 hour digests in order, so it tells a change of any hour.
    """
    low, high = _day(date)
    spark = events.sparkSession
    hour = F.floor((F.unix_micros("ts") - low) / HOUR).alias("hour")
    today = lambda df: df.where((F.unix_micros("ts") >= low) & (F.unix_micros("ts") < high))
    said = today(events).groupBy(hour).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("session_id").alias("sessions"))
    used = today(usage).groupBy(hour).agg(F.count(F.lit(1)).alias("requests"), F.sum("output_tokens").alias("output_tokens"))
    cut = spans.select(F.greatest("lo", low).alias("lo"), F.least("hi", high).alias("hi")).where("hi > lo")
    pieces = cut.select("lo", "hi", F.explode(F.sequence(F.floor((F.col("lo") - low) / HOUR), F.floor((F.col("hi") - 1 - low) / HOUR))).alias("hour"))
    busy = pieces.groupBy("hour").agg(F.sum(F.least("hi", low + (F.col("hour") + 1) * HOUR) - F.greatest("lo", low + F.col("hour") * HOUR)).alias("agent_micros"))
    rows = spark.range(24).select(F.col("id").alias("hour"))
    for part in (said, used, busy, first_seen(date, spans, usage, events, sessions)):
        rows = rows.join(part, "hour", "left")
    rows = rows.na.fill(0)
    fields = rows.columns[1:]
    rows = rows.withColumn("period", F.format_string(f"{date}-%02d", "hour"))
    rows = rows.withColumn("digest", F.sha2(F.concat_ws("|", "period", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in fields)).cast("binary"), 256))
    whole = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "digest"))), lambda x: x["digest"]).alias("all"))  # 24 rows
    return rows.join(whole.select(F.sha2(F.array_join("all", ",").cast("binary"), 256).alias("day_digest")), F.lit(True)).drop("hour")
