"""A mirror that a stream keeps current (S9): only sessions whose fingerprint changed are replaced, sessions that leave the scope go.

The mirror is a folder of Parquet, messages and fingerprints, both by bucket of the session. A batch rewrites the buckets that hold
sessions it replaces or removes, and no other file. What it writes follows from the mirror and the batch alone, and rows that are
there already count once, so a batch that is run again after a failure at any point leaves the same mirror.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import staged
from ..operators.maintain import changed, fingerprints

#: Sessions are dealt to so many buckets; take as many as make a bucket's file some 100 MB.
BUCKETS = 16


def _there(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path; an empty one of the same columns before the first batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def _replace(rows: DataFrame, path: str) -> None:
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert(batch: DataFrame, path: str, key: str, fields: list[str], in_scope: Column, gone: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Brings the mirror at `path` up to date with a batch of messages.

    key: the column that tells a session's rows apart; of rows with one key the batch's is kept. fields: the columns that fingerprints are
    made of (M1). Sessions of which the batch changes nothing stay untouched (M2). Sessions with a row out of `in_scope`, or that `gone`
    (session_id) names, are removed (M3). A bucket that has no row left keeps an empty file.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")
    new = batch.withColumn("bucket", bucket)
    touched = new.select("session_id", "bucket").distinct()
    if gone is not None:
        touched = touched.unionByName(gone.select("session_id").withColumn("bucket", bucket)).distinct()
    touched = staged(touched)
    held = _there(spark, f"{path}/messages", new.select(*batch.columns, "bucket"))
    old = held.join(touched, ["session_id", "bucket"], "left_semi")
    rows = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    rows = rows.groupBy("session_id", key).agg(F.max_by(F.struct(*batch.columns, "bucket"), "fresh").alias("r")).select("r.*")
    lost = rows.groupBy("session_id").agg(F.bool_or(~F.coalesce(in_scope, F.lit(False))).alias("out")).where("out").select("session_id")
    if gone is not None:
        lost = lost.unionByName(gone.select("session_id")).distinct()
    rows = staged(rows.join(lost, "session_id", "left_anti"))
    prints = staged(fingerprints(rows, fields).withColumn("bucket", bucket))
    known = _there(spark, f"{path}/fingerprints", prints)
    before = known.join(touched, ["session_id", "bucket"], "left_semi").drop("bucket")
    moved = staged(changed(prints.drop("bucket"), before).withColumn("bucket", bucket))
    dirty = [r.bucket for r in moved.select("bucket").distinct().collect()]  # at most `buckets` numbers
    if not dirty:
        return
    # Written apart first: the mirror can't be read and replaced at once.
    for table, fresh, now in (("messages", rows, held), ("fingerprints", prints, known)):
        kept = now.where(F.col("bucket").isin(dirty)).join(moved.select("session_id"), "session_id", "left_anti")
        whole = staged(kept.unionByName(fresh.join(moved.select("session_id"), "session_id", "left_semi").select(now.columns)))
        _replace(whole, f"{path}/{table}")
        empty = set(dirty) - {r.bucket for r in whole.select("bucket").distinct().collect()}
        for b in empty:
            now.limit(0).drop("bucket").write.mode("overwrite").parquet(f"{path}/{table}/bucket={b}")


def keep(messages: DataFrame, path: str, state: str, key: str, fields: list[str], in_scope: Column, gone: Callable[[], DataFrame] | None = None, buckets: int = BUCKETS):
    """Starts the stream that keeps the mirror and takes all there is; `gone` is asked at each batch."""

    def one(batch: DataFrame, no: int) -> None:
        upsert(batch, path, key, fields, in_scope, gone() if gone else None, buckets)

    return messages.writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()
