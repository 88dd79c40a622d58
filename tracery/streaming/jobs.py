"""Live counterparts: counters, versions, deduplicated usage windows, activity sessions, incremental upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import folder_for
from ..sources.tables import messages_rows, read


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from the files of `events`, each file once (S1). Ordinals need all of a session, so they are left to the batch."""
    schema = read(spark, sf_dir, "events").schema
    return messages_rows(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))


def live_counts(messages: DataFrame) -> DataFrame:
    """Messages and output tokens by project, kept current."""
    return messages.groupBy("project").agg(F.count(F.lit(1)).alias("messages"), F.sum("output_tokens").alias("output_tokens"))


def versions(messages: DataFrame) -> DataFrame:
    """Count and latest message of each session; in update mode only sessions that changed come out (S3)."""
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.max("ts").alias("version"))


def usage_windows(messages: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Output tokens in tumbling windows, requests that come twice within the delay counted once."""
    rows = messages.where("role = 'assistant'").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return rows.groupBy(F.window("ts", size).alias("w")).agg(F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("requests")).select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "output_tokens", "requests")


def activity_sessions(messages: DataFrame, gap: str = "300 seconds", delay: str = "10 minutes") -> DataFrame:
    """Stretches of a user's messages with no gap over 300 s."""
    rows = messages.withWatermark("ts", delay)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("messages")).select("user_id", F.unix_micros("w.start").alias("start"), "messages")


def status(messages: DataFrame, now: str) -> DataFrame:
    """active, stale or unclean by the time since a session's last message."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("version")
    return versions(messages).select("session_id", F.when(age < 600_000_000, "active").when(age < 3_600_000_000, "stale").otherwise("unclean").alias("status"))


#: Sessions are dealt to so many groups by hash: a call of Python and a row of state for each of these, not for each session.
GROUPS = 1 << 12


def recomputes(messages: DataFrame, interval: int = 60, quiet: int = 10, delay: str = "10 minutes") -> DataFrame:
    """session_id, at (microseconds): when the signals of sessions with new messages are computed anew.

    At once if that was `interval` seconds ago or more, else when the session has been quiet for `quiet` seconds or the interval is over. Times are the
    messages' own, and timers fire by the watermark, so reruns agree. A session's state is two instants; it is dropped when the watermark has passed the
    interval, since a message that isn't late is then computed at once, as a session's first one is.
    """
    step, rest = interval * 1_000_000, quiet * 1_000_000

    def run(key, frames, state):
        import numpy as np
        import pandas as pd

        known = {s: (last, marked) for s, last, marked in zip(*state.get, strict=True)} if state.exists else {}
        sessions, at = [], []
        due = lambda last, marked: last + step if marked is None else min(last + step, marked + rest)
        own = [f for f in frames if len(f)]
        times = np.concatenate([f["us"].to_numpy() for f in own]) if own else np.empty(0, np.int64)
        names = np.concatenate([f["session_id"].to_numpy(dtype=object) for f in own]) if own else np.empty(0, object)
        order = np.argsort(times, kind="stable")
        for s, t in zip(names[order].tolist(), times[order].tolist(), strict=True):
            last, marked = known.get(s, (None, None))
            # Before a message, what is due by then is done.
            if marked is not None and due(last, marked) <= t:
                last, marked = due(last, marked), None
                sessions.append(s)
                at.append(last)
            if last is None or t - last >= step:
                last, marked = t, None
                sessions.append(s)
                at.append(t)
            else:
                marked = t
            known[s] = last, marked
        # So is what is due by the watermark.
        now, left = state.getCurrentWatermarkMs() * 1000, {}
        for s, (last, marked) in known.items():
            if marked is not None and due(last, marked) <= now:
                last, marked = due(last, marked), None
                sessions.append(s)
                at.append(last)
            if marked is not None or last + step > now:
                left[s] = last, marked
        if left:
            state.update((list(left), [x for x, _ in left.values()], [x for _, x in left.values()]))
            # A timer fires when the watermark is past it, so a millisecond before what is due.
            state.setTimeoutTimestamp(max(min(-(-due(*x) // 1000) for x in left.values()) - 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"session_id": sessions, "at": pd.Series(at, dtype="int64")})

    group = F.pmod(F.xxhash64("session_id"), F.lit(GROUPS)).alias("group")
    rows = messages.withWatermark("ts", delay).select(group, "session_id", "ts", F.unix_micros("ts").alias("us"))
    state = "sessions array<string>, last array<long>, marked array<long>"
    return rows.groupBy("group").applyInPandasWithState(run, "session_id string, at long", state, "append", "EventTimeTimeout")


def run_to_end(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns its result table: appended rows, or the last complete state.

    Each micro-batch replaces its own folder, so one that is run again after a failure counts once (S9).
    """
    spark, folder = df.sparkSession, folder_for(df.sparkSession)

    def keep(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={no if mode == 'append' else 0}")

    query = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out/batch=*")
