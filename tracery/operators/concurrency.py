"""Activity intervals and concurrency: capped gaps, exact sweeps, buckets, timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import place_among
from ..functions.storage import staged
from ..sources.tables import Tables

GAP = 300_000_000  # microseconds


def intervals(t: Tables) -> DataFrame:
    """Spans [lo, hi) in microseconds between neighbouring messages of a session, each capped at 300 s, with the model used last (R2).

    Only positive gaps make spans and set the model.
    """
    own = Window.partitionBy("session_id").orderBy("ordinal")
    rows = t.messages.withColumn("at", F.unix_micros("ts")).withColumn("lo", F.lag("at").over(own)).where(F.col("at") > F.col("lo"))
    used = F.last(F.when(F.col("role") == "assistant", F.col("model")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("session_id", "project", "agent", "is_automated", "lo", F.least("at", F.col("lo") + GAP).alias("hi"), F.coalesce(used, F.lit("")).alias("model"))


def bounds(spans: DataFrame, *keys: str, kind: str | None = None) -> DataFrame:
    """Net change of the number of open spans at each instant, and of those of a kind (a column of 0 and 1); closes and opens of one instant cancel out."""
    ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d"))))
    also = [F.sum(F.col("e.d") * F.col(kind)).alias(kind)] if kind else []
    return spans.withColumn("e", ends).groupBy(*keys, "e.at").agg(F.sum("e.d").alias("d"), *also)


def levels(spans: DataFrame, kind: str | None = None) -> DataFrame:
    """Instants with the number of open spans from there on (and of those of a kind), and the next instant.

    Running sums are taken in two levels: instants are cut at quantiles, so a part has about as many of them as any other, and parts are
    as many as the shuffle has partitions; their sums are added up first.
    """
    net = staged(bounds(spans, kind=kind))
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = net.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    net = net.withColumn("part", place_among(F.col("at"), sorted(set(cuts or []))))
    sums = ["d", *([kind] if kind else [])]
    each = net.groupBy("part").agg(*(F.sum(c).alias(f"s_{c}") for c in sums), F.min("at").alias("first"))
    every = Window.orderBy("part")  # one row for each part
    each = each.select("part", *((F.sum(f"s_{c}").over(every) - F.col(f"s_{c}")).alias(f"b_{c}") for c in sums), F.lead("first").over(every).alias("next_part"))
    own = Window.partitionBy("part").orderBy("at")
    upto = {c: F.sum(c).over(own) + F.col(f"b_{c}") for c in sums}
    net = net.join(F.broadcast(each), "part")
    return net.select("at", upto["d"].alias("open"), F.coalesce(F.lead("at").over(own), F.col("next_part")).alias("next"), *([upto[kind].alias(kind)] if kind else []))


def concurrency(t: Tables) -> DataFrame:
    """Peak of open spans, when it first came, and minutes with any span open."""
    out = levels(intervals(t))
    return out.agg(F.max("open").alias("peak"), (-F.max(F.struct("open", -F.col("at")))["col2"]).alias("peak_at"), F.round(F.sum(F.when(F.col("open") > 0, F.col("next") - F.col("at"))) / 6e7, 4).alias("active_minutes"))


def in_buckets(spans: DataFrame, width: int) -> DataFrame:
    """Spans cut at the bounds of buckets of `width` microseconds that they touch."""
    first, last = F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)
    cut = spans.withColumn("b", F.explode(F.sequence(first, last)))
    return cut.withColumn("lo", F.greatest("lo", F.col("b") * width)).withColumn("hi", F.least("hi", (F.col("b") + 1) * width))


def bucket_metrics(t: Tables, width: int = 3_600_000_000) -> DataFrame:
    """Agent minutes and most open spans of each hour (R4); the most is that of the levels which the hour overlaps."""
    own = intervals(t)
    open_ = levels(own).where("open > 0").select("open", F.col("at").alias("lo"), F.col("next").alias("hi"))
    peak = in_buckets(open_, width).groupBy("b").agg(F.max("open").alias("most"))
    minutes = in_buckets(own, width).groupBy("b").agg(F.round(F.sum(F.col("hi") - F.col("lo")) / 6e7, 4).alias("minutes"))
    return minutes.join(peak, "b").select(F.col("b").alias("hour"), "minutes", F.col("most").cast("long").alias("most"))


def by_session(t: Tables) -> DataFrame:
    """Minutes of each session and the model that has most of them, ties by name."""
    m = intervals(t).groupBy("session_id", "model").agg(F.sum(F.col("hi") - F.col("lo")).alias("us"))
    return m.groupBy("session_id").agg(F.round(F.sum("us") / 6e7, 4).alias("minutes"), F.min(F.struct((-F.col("us")).alias("k"), "model"))["model"].alias("model"))


def by_key(t: Tables) -> DataFrame:
    """Minutes by project, agent and model, automated and not."""
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ("project", "agent", "model"))))
    us = F.col("hi") - F.col("lo")
    return intervals(t).withColumn("side", sides).groupBy("side.kind", "side.label").agg(F.round(F.sum(F.when(F.col("is_automated"), us).otherwise(0)) / 6e7, 4).alias("automated"), F.round(F.sum(F.when(~F.col("is_automated"), us).otherwise(0)) / 6e7, 4).alias("interactive"))


def totals(t: Tables) -> DataFrame:
    """Agent minutes, sessions, projects and models with activity."""
    return intervals(t).agg(F.round(F.sum(F.col("hi") - F.col("lo")) / 6e7, 4).alias("agent_minutes"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("project").alias("projects"), F.count_distinct(F.when(F.col("model") != "", F.col("model"))).alias("models"))


def candidates(t: Tables, first: str = "2024-01-08", last: str = "2024-01-10") -> DataFrame:
    """Sessions whose span meets the range."""
    return t.sessions.where((F.col("started_at") < F.lit(last).cast("timestamp")) & (F.col("ended_at") >= F.lit(first).cast("timestamp"))).select("session_id")


def listing(t: Tables) -> DataFrame:
    """Spans at the resolution of seconds."""
    second = lambda c: F.floor(F.col(c) / 1_000_000)
    return intervals(t).select("session_id", second("lo").alias("lo"), second("hi").alias("hi"), "model")


def first_seen(t: Tables) -> DataFrame:
    """For each hour, sessions, projects and models that were first seen in it."""
    hour = lambda c: F.date_format(F.date_trunc("hour", c), "yyyy-MM-dd HH")
    parts = [t.messages.where(F.col(c) != "").groupBy(c).agg(F.min("ts").alias("first")).select(F.lit(kind).alias("kind"), hour("first").alias("hour")) for kind, c in (("sessions", "session_id"), ("projects", "project"), ("models", "model"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("hour", "kind").agg(F.count(F.lit(1)).alias("n"))


def strip(t: Tables, parts: int = 30) -> DataFrame:
    """Messages of each session in at most `parts` equal steps of its span, empty ones filled in."""
    ends = t.messages.groupBy("session_id").agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))
    ends = ends.withColumn("step", F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / parts), F.lit(1)).cast("long"))
    spine = ends.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / F.col("step")))))
    own = t.messages.join(ends, "session_id").groupBy("session_id", F.floor((F.unix_micros("ts") - F.col("lo")) / F.col("step")).alias("i")).agg(F.count(F.lit(1)).alias("messages"), F.min("ordinal").alias("first_ordinal"))
    return spine.join(own, ["session_id", "i"], "left").select("session_id", "i", F.coalesce("messages", F.lit(0)).alias("messages"), F.col("first_ordinal").cast("long").alias("first_ordinal"))


#: Preferred widths of a strip's buckets in seconds, how many buckets are aimed at, and how many there are at most.
STEPS, AIMED, MOST = [60, 120, 300, 600, 900, 1800, 3600, 7200], 30, 50


def snapped(seconds: Column) -> Column:
    """The width of a strip's buckets for a session of so many seconds: the preferred one nearest to a thirtieth of it, the larger of two, or wider where that makes more than MOST."""
    target = F.floor(seconds / AIMED)
    near = F.array_min(F.transform(F.array(*(F.lit(s).cast("long") for s in STEPS)), lambda s: F.struct(F.abs(s - target).alias("far"), (-s).alias("size"))))
    best = F.when((seconds <= 0) | (target <= STEPS[0]), F.lit(STEPS[0]).cast("long")).otherwise(-near["size"])
    return F.when(F.floor(seconds / best) + 1 > MOST, F.floor((seconds + MOST - 2) / (MOST - 1))).otherwise(best)


def laddered_strip(messages: DataFrame) -> DataFrame:
    """session_id, seconds (a bucket's width), i, user, assistant, first_ordinal: visible messages in buckets from a session's first to its last, empty ones filled in.

    messages: session_id, ordinal, role, ts and is_system; those of the system or without a time don't count.
    """
    seen = messages.where("not is_system and ts is not null").withColumn("at", F.unix_micros("ts"))
    ends = seen.groupBy("session_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    ends = ends.withColumn("seconds", snapped(F.floor((F.col("hi") - F.col("lo")) / 1_000_000)))
    place = F.floor((F.col("at") - F.col("lo")) / (F.col("seconds") * 1_000_000))
    own = seen.join(ends, "session_id").groupBy("session_id", place.alias("i")).agg(F.count_if(F.col("role") == "user").alias("user"), F.count_if(F.col("role") == "assistant").alias("assistant"), F.min("ordinal").cast("long").alias("first_ordinal"))
    spine = ends.select("session_id", "seconds", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / (F.col("seconds") * 1_000_000)))).alias("i"))
    return spine.join(own, ["session_id", "i"], "left").select("session_id", "seconds", "i", F.coalesce("user", F.lit(0)).alias("user"), F.coalesce("assistant", F.lit(0)).alias("assistant"), "first_ordinal")


def turns(t: Tables) -> DataFrame:
    """Duration of each user turn up to the next one, or to the end of the session; negative ones are null."""
    own = Window.partitionBy("session_id").orderBy("ordinal")
    rows = t.messages.where("role = 'user'").withColumn("next", F.lead("ts").over(own)).join(t.sessions.select("session_id", "ended_at"), "session_id")
    d = F.unix_micros(F.coalesce("next", "ended_at")) - F.unix_micros("ts")
    return rows.select("session_id", "ordinal", F.when(d >= 0, d).alias("micros"))


def digest(t: Tables, n: int = 3) -> DataFrame:
    """The n greatest labels of each kind by minutes."""
    order = Window.partitionBy("kind").orderBy(F.desc(F.col("automated") + F.col("interactive")), "label")
    return by_key(t).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("kind", "label", "place")
