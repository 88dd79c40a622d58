"""The session model over the given tables: one deterministic lens in the DataFrame API, and its twin in DuckDB's SQL.

Messages come from `events` (a session is a user's week), tool calls from `lineitem` (a session is an order),
text sessions from `conversations`. Every operator takes these DataFrames, so it runs alike over a real
archive of the same columns.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables(NamedTuple):
    """messages: ordered turns with token usage. sessions: one row for each session, with the tree of parents.
    calls: tool calls in order. turns: text messages. Column lists: `messages_of` and the others below."""

    messages: DataFrame
    sessions: DataFrame
    calls: DataFrame
    turns: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages_rows(events: DataFrame) -> DataFrame:
    """Messages without their ordinals: each follows from its own row, so streams have them too."""
    user, week = F.col("user_id"), F.date_format(F.date_trunc("week", F.col("ts").cast("timestamp")), "yyyy-MM-dd")
    assistant = F.col("event_type").isin("purchase", "error")
    tokens = F.floor("value").cast("long")
    keyed = F.col("event_id") % 5 != 0
    return events.select(
        F.concat_ws("-", user.cast("string"), week).alias("session_id"),
        F.when(assistant, "assistant").otherwise("user").alias("role"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "user_id",
        F.when(assistant, F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))).otherwise("").alias("model"),
        tokens.alias("content_length"),
        F.when(assistant, tokens).otherwise(0).alias("output_tokens"),
        F.when(assistant, F.col("event_id") % 1000).otherwise(0).alias("input_tokens"),
        F.when(assistant, F.get_json_object("props", "$.k").cast("long")).otherwise(0).alias("cache_read"),
        F.when(assistant, F.col("event_id") % 50).otherwise(0).alias("cache_creation"),
        F.concat(F.lit("p"), (user % 5).cast("string")).alias("project"),
        F.concat(F.lit("a"), (user % 3).cast("string")).alias("agent"),
        F.concat(F.lit("h"), (user % 4).cast("string")).alias("machine"),
        F.concat(F.lit("b"), (user % 2).cast("string")).alias("branch"),
        (user % 7 == 0).alias("is_automated"),
        (F.col("event_id") % 6 == 0).alias("has_thinking"),
        (F.col("event_type") == "purchase").alias("has_tool_use"),
        F.when(keyed, F.floor(F.col("event_id") / 4).cast("string")).otherwise("").alias("message_id"),
        F.when(keyed, F.col("event_type")).otherwise("").alias("request_id"),
        (F.col("event_id") % 97).cast("string").alias("source_uuid"),
    )


def messages_of(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    return messages_rows(events).withColumn("ordinal", F.row_number().over(order) - 1)


def sessions_of(messages: DataFrame) -> DataFrame:
    """Each session, with the user's session before as its parent and a relationship by the user's number."""
    one = messages.groupBy("session_id", "user_id", "project", "agent", "machine", "branch", "is_automated").agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count(F.lit(1)).alias("message_count"),
        F.count_if(F.col("role") == "user").alias("user_message_count"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.max(F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation")).alias("peak_context_tokens"),
    )
    before = F.lag("session_id").over(Window.partitionBy("user_id").orderBy("session_id"))
    kind = F.when(before.isNull(), "").when(F.col("user_id") % 4 == 1, "subagent").when(F.col("user_id") % 4 == 2, "fork").when(F.col("user_id") % 4 == 3, "continuation").otherwise("")
    one = one.withColumn("relationship", kind).withColumn("parent_id", F.when(F.col("user_id") % 4 != 0, before))
    return one.withColumn("cwd", F.concat(F.lit("/work/"), "project", F.lit("/"), "branch", F.lit("/src/u"), F.col("user_id").cast("string")))


def calls_of(lineitem: DataFrame) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("Bash", "Edit", "Read", "Write", "Task"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return lineitem.select(
        F.col("l_orderkey").alias("session_id"),
        (F.row_number().over(order) - 1).alias("call_index"),
        F.col("l_linenumber").alias("ordinal"),
        kind.alias("category"),
        F.concat(F.lower(kind), F.lit("_tool")).alias("tool_name"),
        (F.col("l_partkey") % 4).cast("string").alias("input"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string")).alias("file_path"),
        (F.col("l_returnflag") == "R").alias("failed"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.floor(F.col("l_extendedprice") / 100).cast("long").alias("context_tokens"),
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("s"), (F.col("l_partkey") % 6).cast("string"))).otherwise("").alias("skill"),
    )


#: A task that holds sessions of calls in order has about so many rows.
TASK_ROWS = 500_000


def finely(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key to tasks of about TASK_ROWS, where the session's number of shuffle partitions would give a task more: what a task sorts then doesn't grow with the table."""
    parts = -(-df.count() // TASK_ROWS)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), "role", F.col("text").alias("content"), (F.col("role") == "system").alias("is_system"), (F.col("turn") % 5 == 3).alias("is_sidechain"))


def lens(spark: SparkSession, sf_dir: str) -> Tables:
    messages = messages_of(read(spark, sf_dir, "events"))
    return Tables(messages, sessions_of(messages), calls_of(finely(read(spark, sf_dir, "lineitem"), "l_orderkey")), turns_of(read(spark, sf_dir, "conversations")))


#: The same in SQL; an oracle is one of the engine's queries after this.
LENS_SQL = """WITH messages AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS ordinal FROM (
    SELECT user_id || '-' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS session_id, CASE WHEN a THEN 'assistant' ELSE 'user' END AS role,
      ts, event_id, event_type, user_id, CASE WHEN a THEN 'm' || (event_id % 3) ELSE '' END AS model, floor(value)::BIGINT AS content_length,
      CASE WHEN a THEN floor(value)::BIGINT ELSE 0 END AS output_tokens, CASE WHEN a THEN event_id % 1000 ELSE 0 END AS input_tokens,
      CASE WHEN a THEN json_extract_string(props, '$.k')::BIGINT ELSE 0 END AS cache_read, CASE WHEN a THEN event_id % 50 ELSE 0 END AS cache_creation,
      'p' || (user_id % 5) AS project, 'a' || (user_id % 3) AS agent, 'h' || (user_id % 4) AS machine, 'b' || (user_id % 2) AS branch,
      user_id % 7 = 0 AS is_automated, event_id % 6 = 0 AS has_thinking, event_type = 'purchase' AS has_tool_use,
      CASE WHEN event_id % 5 <> 0 THEN (event_id // 4)::VARCHAR ELSE '' END AS message_id, CASE WHEN event_id % 5 <> 0 THEN event_type ELSE '' END AS request_id,
      (event_id % 97)::VARCHAR AS source_uuid
    FROM (SELECT *, event_type IN ('purchase', 'error') AS a FROM events))),
sessions AS (
  SELECT *, CASE WHEN prev IS NULL THEN '' WHEN user_id % 4 = 1 THEN 'subagent' WHEN user_id % 4 = 2 THEN 'fork' WHEN user_id % 4 = 3 THEN 'continuation' ELSE '' END AS relationship,
    CASE WHEN user_id % 4 <> 0 THEN prev END AS parent_id, '/work/' || project || '/' || branch || '/src/u' || user_id AS cwd FROM (
    SELECT *, lag(session_id) OVER (PARTITION BY user_id ORDER BY session_id) AS prev FROM (
      SELECT session_id, user_id, project, agent, machine, branch, is_automated, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS message_count,
        count(*) FILTER (role = 'user') AS user_message_count, sum(output_tokens)::BIGINT AS total_output_tokens, max(input_tokens + cache_read + cache_creation) AS peak_context_tokens
      FROM messages GROUP BY ALL))),
calls AS (
  SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS call_index, l_linenumber AS ordinal,
    ['Bash', 'Edit', 'Read', 'Write', 'Task'][l_suppkey % 5 + 1] AS category, lower(['Bash', 'Edit', 'Read', 'Write', 'Task'][l_suppkey % 5 + 1]) || '_tool' AS tool_name,
    (l_partkey % 4)::VARCHAR AS input, 'f' || (l_partkey % 3) AS file_path, l_returnflag = 'R' AS failed, l_shipdate AS ts, floor(l_extendedprice / 100)::BIGINT AS context_tokens,
    CASE WHEN l_suppkey % 3 = 0 THEN 's' || (l_partkey % 6) ELSE '' END AS skill FROM lineitem),
turns AS (SELECT conv_id AS session_id, turn AS ordinal, role, text AS content, role = 'system' AS is_system, turn % 5 = 3 AS is_sidechain FROM conversations)"""
