"""Signals of many sessions in one view: distributions by agent, project and day, what each signal goes with, and sessions that show it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRADES = ["A", "B", "C", "D", "F"]
OUTCOMES = ["completed", "abandoned", "errored", "unknown"]
#: Signals that count something in a session, and those that hold or don't.
COUNTED = ["failures", "retries", "churned", "compactions", "mid_task", "short_prompts", "no_criteria", "no_checks", "no_context", "repeats"]
FLAGS = ["unstructured", "runaway"]


def strength(signal: str) -> Column:
    """How much of a signal a session has."""
    return F.coalesce(F.col(signal).cast("long"), F.lit(0).cast("long"))


def distributions(signals: DataFrame) -> DataFrame:
    """kind (all, agent, project or day), label, sessions, scored ones, mean score, sessions by grade and outcome, and the totals of each signal.

    signals: the columns of `prompts.signals` with agent, project and day. All four views come from one pass (grouping sets), aggregated before the shuffle.
    """
    sets = [[], ["agent"], ["project"], ["day"]]
    n = lambda test, name: F.count_if(test).alias(name)
    told = [F.count(F.lit(1)).alias("sessions"), F.count("score").alias("scored"), F.round(F.avg("score"), 4).alias("mean_score")]
    told += [n(F.col("grade") == g, f"grade_{g.lower()}") for g in GRADES] + [n(F.col("outcome") == o, o) for o in OUTCOMES]
    told += [F.sum(strength(s)).alias(s) for s in COUNTED + FLAGS] + [n(strength(s) > 0, f"with_{s}") for s in COUNTED + FLAGS]
    place = F.grouping_id("agent", "project", "day")  # a bit for each column that is not grouped by
    kinds = {7: "all", 3: "agent", 5: "project", 6: "day"}
    rows = signals.select("agent", "project", F.col("day").cast("string").alias("day"), "score", "grade", "outcome", *COUNTED, *FLAGS).groupingSets([[F.col(c) for c in s] for s in sets], "agent", "project", "day").agg(place.alias("place"), *told)
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("place").cast("int"))
    label = F.when(kind == "agent", F.col("agent")).when(kind == "project", F.col("project")).when(kind == "day", F.col("day")).otherwise("")
    return rows.select(kind.alias("kind"), label.alias("label"), *(c for c in rows.columns if c not in ("agent", "project", "day", "place")))


def calibration(signals: DataFrame) -> DataFrame:
    """For each signal the sessions that have it and that don't, their mean scores, the share of either that was abandoned or ended in errors, and its lift.

    lift: the share with the signal over that without it; null if no session without it ended so. Sessions of unknown outcome count in no share.
    """
    names = COUNTED + FLAGS
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), (strength(s) > 0).alias("has")) for s in names)))
    rows = signals.select("score", "outcome", each.alias("e")).select("score", "e.signal", "e.has", F.when(F.col("outcome") != "unknown", F.col("outcome").isin("abandoned", "errored").cast("double")).alias("bad"))
    when = lambda test, value: F.when(F.col("has") if test else ~F.col("has"), value)
    one = rows.groupBy("signal").agg(
        F.count_if("has").alias("having"), F.count_if(~F.col("has")).alias("lacking"),
        F.avg(when(True, F.col("score"))).alias("s1"), F.avg(when(False, F.col("score"))).alias("s0"), F.avg(when(True, F.col("bad"))).alias("b1"), F.avg(when(False, F.col("bad"))).alias("b0"),
    )
    return one.select("signal", "having", "lacking", F.round("s1", 4).alias("score_having"), F.round("s0", 4).alias("score_lacking"), F.round("b1", 6).alias("bad_having"), F.round("b0", 6).alias("bad_lacking"), F.when(F.col("b0") > 0, F.round(F.col("b1") / F.col("b0"), 6)).alias("lift"))


def shown_by(signals: DataFrame, messages: DataFrame, n: int = 10, length: int = 160) -> DataFrame:
    """signal, place, session_id, value, ordinal and excerpt: for each signal the n sessions with most of it, ties by id, and how their first prompt begins."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), strength(s).alias("value")) for s in COUNTED + FLAGS)))
    rows = signals.select("session_id", each.alias("e")).select("session_id", "e.*").where("value > 0")
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy("signal").orderBy(F.desc("value"), "session_id"))).where(F.col("place") <= n)
    few = top.select("session_id").distinct()  # n for each signal
    said = messages.where("role = 'user' and not is_system").join(few, "session_id", "left_semi").groupBy("session_id").agg(F.min(F.struct("ordinal", "content")).alias("m"))
    return top.join(said, "session_id", "left").select("signal", "place", "session_id", "value", F.col("m.ordinal").alias("ordinal"), F.substring("m.content", 1, length).alias("excerpt"))
