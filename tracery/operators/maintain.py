"""Change detection and incremental maintenance, and exports: fingerprints, diffs, plans, feeds, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Tables


def text_of(columns: list[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))


FIELDS = ["ordinal", "role", "model", "content_length", "output_tokens", "message_id", "request_id"]


def fingerprints(messages: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """session_id, fingerprint: a hash over a session's rows that doesn't depend on their order (M1).

    Rows' hashes are added up, so the sum is built in part before the shuffle and no session is gathered.
    """
    part = F.conv(F.substring(F.sha2(text_of(fields or FIELDS).cast("binary"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    sums = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("s"))
    return sums.select("session_id", F.sha2(F.concat_ws(":", "session_id", F.col("n").cast("string"), F.col("s").cast("string")).cast("binary"), 256).alias("fingerprint"))


def archive_fingerprints(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """session_id, fingerprint of all that a session has in several tables (M1): messages, usage, calls, findings, pins and others.

    parts: a name, and a table with session_id and the fields that count. A row's hash is taken over its table's name and its fields, so
    that a row that moves to another table changes the print; hashes are added up in one shuffle of the tables' union, in whatever order.
    """
    rows = None
    for name, (df, fields) in parts.items():
        value = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(name), text_of(fields)).cast("binary"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
        own = df.select(F.col("session_id").cast("string").alias("session_id"), value.alias("v"))
        rows = own if rows is None else rows.unionByName(own)
    sums = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    return sums.select("session_id", F.sha2(F.concat_ws(":", "session_id", F.col("n").cast("string"), F.col("s").cast("string")).cast("binary"), 256).alias("fingerprint"))


def changed(now: DataFrame, mirror: DataFrame) -> DataFrame:
    """Sessions that are new, changed or gone against a mirror's fingerprints (M2, M3)."""
    both = now.join(mirror.withColumnRenamed("fingerprint", "old"), "session_id", "full")
    kind = F.when(F.col("old").isNull(), "new").when(F.col("fingerprint").isNull(), "gone").when(F.col("fingerprint") != F.col("old"), "changed")
    return both.select("session_id", kind.alias("change")).where("change is not null")


def diff_plan(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """For each session how to bring it up to date: append, update, or replace all if rows are missing or over half would change (M4)."""
    a, b = (df.select("session_id", "ordinal", text_of(FIELDS[1:]).alias(n)) for df, n in ((stored, "old"), (incoming, "new")))
    rows = a.join(b, ["session_id", "ordinal"], "full")
    n = lambda c, name: F.count_if(c).alias(name)
    one = rows.groupBy("session_id").agg(n(F.col("old").isNull(), "added"), n(F.col("new").isNull(), "missing"), n(F.col("old") != F.col("new"), "updated"), n(F.col("old").isNotNull(), "stored"))
    plan = F.when((F.col("missing") > 0) | (F.col("updated") * 2 > F.col("stored")), "replace").when(F.col("updated") > 0, "update").when(F.col("added") > 0, "append").otherwise("none")
    return one.select("session_id", "added", "updated", plan.alias("plan"))


def multiset_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that one side has more often, and by how much (M5)."""
    count = lambda df, name: df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
    both = count(a, "left").join(count(b, "right"), columns, "full").na.fill(0, ["left", "right"])
    return both.where("left <> right")


def archive_diff(tables: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """table, added, removed, rows: how many rows of each table only a new archive has, only an old one, and both (M5).

    tables: a name, the old rows, the new ones and the columns that count, in which rows may repeat. All tables are compared in one shuffle of their rows' hashes.
    """
    rows = None
    for name, (old, new, columns) in tables.items():
        for df, side in ((old, -1), (new, 1)):
            own = df.select(F.lit(name).alias("table"), F.sha2(F.concat_ws("|", F.lit(name), text_of(columns)).cast("binary"), 256).alias("row"), F.lit(side).alias("side"))
            rows = own if rows is None else rows.unionByName(own)
    each = rows.groupBy("table", "row").agg(F.count_if(F.col("side") < 0).alias("o"), F.count_if(F.col("side") > 0).alias("n"))
    more = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
    return each.groupBy("table").agg(more("n", "o").alias("added"), more("o", "n").alias("removed"), F.sum(F.least("n", "o")).alias("rows"))


def carry_over(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new build and the rows of keys that only the old one has (M6)."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def latest(journal: DataFrame, key: str, revision: str, after: int, through: int) -> DataFrame:
    """The last row of each key with a revision in (after, through] (M7, M8)."""
    rows = journal.where((F.col(revision) > after) & (F.col(revision) <= through))
    return rows.groupBy(key).agg(F.max_by(F.struct(*journal.columns), revision).alias("r")).select("r.*")


def merge_origins(inputs: dict[str, DataFrame], key: str, revision: str) -> DataFrame:
    """Archives of several origins as one: keys get their origin before them, the newest revision of each wins (M9)."""
    out = None
    for origin, df in inputs.items():
        own = df.withColumn(key, F.concat(F.lit(f"{origin}~"), F.col(key)))
        out = own if out is None else out.unionByName(own)
    order = Window.partitionBy(key).orderBy(F.desc(revision))
    return out.withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")


def session_export(t: Tables) -> DataFrame:
    """One summary row for each session, ready for write.json or write.csv (K2)."""
    by = t.messages.where("model <> ''").groupBy("session_id").agg(F.count_distinct("model").alias("models"), F.sum("output_tokens").alias("output_tokens"))
    return t.sessions.join(by, "session_id", "left").select("session_id", "project", "agent", "message_count", (F.unix_micros("ended_at") - F.unix_micros("started_at")).alias("micros"), F.coalesce("models", F.lit(0)).alias("models"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"))


def reporting_day(t: Tables, date: str = "2024-01-10") -> DataFrame:
    """24 hours of a day with messages, sessions and a digest of each (K3)."""
    hours = t.messages.sparkSession.range(24).select(F.col("id").alias("hour"))
    own = t.messages.where((F.col("ts") >= F.lit(date).cast("timestamp")) & (F.col("ts") < F.lit(date).cast("timestamp") + F.expr("interval 1 day")))
    own = own.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("session_id").alias("sessions"), F.sum("output_tokens").alias("output_tokens"))
    rows = F.broadcast(hours).join(own, "hour", "left").na.fill(0)
    return rows.withColumn("digest", F.sha2(text_of(["hour", "messages", "sessions", "output_tokens"]).cast("binary"), 256))


def write_mirror(t: Tables, path: str) -> None:
    """The model as Parquet, by project; only partitions that are written are replaced (K1)."""
    for name, df in t._asdict().items():
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy("project") if "project" in df.columns else writer).parquet(f"{path}/{name}")
